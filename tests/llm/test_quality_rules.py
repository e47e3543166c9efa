import re
from collections import Counter, defaultdict

from tablewright.llm.quality_rules import apply_quality_rules, normal_line, quality_rules

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def facts(i, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts(documents, corpus):
    found = Counter(tuple(r) for r in quality_rules(documents).select(*BASE).collect())
    assert found == Counter(facts(i, t) for i, t, *_ in corpus)


def hosts(spark):
    """Ten documents of a host share two lines, spelled differently; the last three have little else."""
    own = " ".join(f"word{chr(97 + k % 26)}" for k in range(40))
    rows = [(k, f"{own} {chr(97 + k)}\nALL   rights reserved 20{k}\nread more of this", "a") for k in range(7)]
    rows += [(k, f"short {chr(97 + k)}\nall rights reserved 20{k}\nread more of this " + "\nRead more of  this" * 9, "a") for k in range(7, 10)]
    rows += [(20, f"{own}\nread more of this", "b"), (21, None, "b"), (22, own, None), (9, rows[9][1], "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


LIMITS = {"most_documents": 5, "min_words": 10, "most_repeated": 1.0}


def test_lines_above_the_limits_go_but_the_first(spark):
    rows = {r["doc_id"]: r for r in quality_rules(hosts(spark), **LIMITS).collect()}
    assert rows[0]["n_removed_lines"] == 0
    assert all(rows[k]["n_removed_lines"] == 2 and rows[k]["kept"] for k in range(1, 7))
    assert all(not rows[k]["kept"] and not rows[k]["base_failed"] for k in range(7, 10))
    assert rows[20]["n_removed_lines"] == 0 and rows[20]["kept"] and rows[22]["kept"] and not rows[21]["kept"]


def test_copies_of_a_document_count_once(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(k, text, "a") for k in range(50)], "doc_id long, text string, source string")
    assert quality_rules(df, **LIMITS).where("kept").count() == 50


def test_kept_rows_lose_the_lines(spark):
    df = hosts(spark).selectExpr("*", "'x' removed", "1 key")
    kept = apply_quality_rules(df, **LIMITS)
    assert kept.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert sorted(texts) == [0, 1, 2, 3, 4, 5, 6, 20, 22]
    assert "rights" in texts[0] and all("\n" not in texts[k] for k in range(1, 7))


def test_shared_lines_of_a_given_table_go(spark):
    """With the defaults, lines go from a small table and depleted documents are rejected."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = defaultdict(set)
    for r in df.collect():
        for line in (r["text"] or "").encode().split(b"\n"):
            texts[r["source"], normal_line(line)].add(r["text"])
    n_lines = sum(len(v) > 10 and bool(k[1]) for k, v in texts.items())
    rows = quality_rules(df).cache()
    assert 0 < rows.selectExpr("explode(removed) h").distinct().count() <= n_lines
    assert rows.where("n_removed_lines > 0").count() > 5
    depleted = {r["doc_id"] for r in quality_rules(df, most_documents=2).where("not kept and not base_failed").collect()}
    kept = {r["doc_id"] for r in apply_quality_rules(df, most_documents=2).collect()}
    assert depleted and not depleted & kept
    assert kept == {r["doc_id"] for r in rows.where("not base_failed").collect()} - depleted


def test_query_counts_the_documents_of_a_host(spark, tmp_path):
    """A line goes if over 100 documents and a tenth of its host's hold it, as the SQL says."""
    import duckdb

    from tablewright.llm import oracles, queries

    own = [" ".join(chr(97 + (k // 26**j) % 26) * (j + 1) for j in range(25)) for k in range(3200)]
    rows = [(k, own[k] + ("\nheld by many here" if k % 1600 < 150 else ""), "large" if k < 1600 else "small") for k in range(2800)]
    rows += [(k, own[k] + "\nheld by ninety", "little") for k in range(2800, 2890)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = queries.op3_quality_rules(spark, folder)
    lost = {r["source"]: r["n"] for r in found.where("n_removed_lines > 0").join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id").groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert lost == {"small": 149}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    given = con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracles.OP3})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(given)


def test_query_also_sheds_lines_of_few_documents(spark, tmp_path):
    """Lines that more than ten documents hold are counted and judged by that limit alone, beside the limits of a host."""
    import duckdb

    from tablewright.llm import oracles, queries

    folder = "/root/testdata/sf0.01"
    found = queries.op3_quality_rules(spark, folder)
    wide = {r["doc_id"]: r for r in quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    rows = found.collect()
    assert sum(r["n_shared_lines"] > 0 for r in rows) > 5 and len(rows) == len(wide)
    for r in rows:
        own = wide[r["doc_id"]]
        assert (r["n_shared_lines"], r["n_shared_words"], r["kept_without_shared"]) == (own["n_removed_lines"], own["n_removed_words"], own["kept"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    given = con.execute(f"SELECT {', '.join(found.columns)} FROM ({oracles.OP3})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(given)


def test_rows_that_stay_are_not_joined(spark):
    """Untouched rows come through whole and as often as they are there."""
    rows = [(k, " ".join(chr(97 + k % 26) * (k // 26 + 1) + chr(97 + j) for j in range(26)), "a") for k in range(40)] * 2 + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert Counter(tuple(r) for r in apply_quality_rules(df).collect()) == Counter(r for r in rows if r[1])


def test_nothing_in_nothing_out(nothing):
    assert quality_rules(nothing).count() == 0
    assert apply_quality_rules(nothing).count() == 0
