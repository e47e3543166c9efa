from collections import Counter

import corpus_pipeline
from test_jaccard_join import brute
from test_quality_rules import facts


def test_stages_have_the_order_of_the_task():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "mixing", "sharding"]


def test_each_stage_on_all_its_predecessor_kept(spark, tables, tmp_path):
    """Every stage against a plain version on the same rows."""
    folder = "/root/testdata/sf0.001"
    docs = tables("documents")
    rows = [tuple(r) for r in docs.collect()]
    good = {i for i, t, *_ in rows if not facts(i, t)[-1]}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        steps[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in steps["quality"]} == good
    expected = {c for _, n, c in brute([tuple(r) for r in steps["quality"]], 80, 5)}
    assert {r["doc_id"] for r in steps["near_copies"]} == expected
    items = [r["text"] for r in tables("benchmark").collect()]
    clean = {r["doc_id"] for r in steps["near_copies"] if not any(x in r["text"] for x in items)}
    assert {r["doc_id"] for r in steps["benchmark"]} == clean
    counts = Counter(r["doc_id"] for r in steps["mixing"])
    assert set(counts) <= clean and max(counts.values()) <= 3
    total = sum(len(r["text"].split()) for r in steps["benchmark"])
    assert abs(sum(len(r["text"].split()) for r in steps["mixing"]) - total) < 0.1 * total
    assert Counter(r["doc_id"] for r in steps["sharding"]) == counts
    run = corpus_pipeline.run(spark, folder).select("doc_id", "shard", "slot").collect()
    assert Counter(map(tuple, run)) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in steps["sharding"])


def test_columns_named_like_added_ones_survive(spark):
    text = " ".join(f"w{k}" for k in range(40))
    names = ["size", "weight", "target", "taken", "copies", "source_size", "virtual_finish"]
    rows = [(k, f"{text} {k}", "en", f"s{k % 2}", 99, *[f"{n}{k}" for n in names]) for k in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)


def test_quality_stage_removes_shared_lines(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = corpus_pipeline.reject_low_quality(spark, docs, folder).collect()
    shorter = [r for r in after if r["text"] != before[r["doc_id"]]]
    assert shorter and all(len(r["text"]) < len(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in shorter)
