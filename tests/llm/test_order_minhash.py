import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import order_minhash as om
from tablewright.llm.order_minhash import edited_fingerprints, fingerprints, likeness, order_minhash


def signed(x, bits=64):
    x &= 2**bits - 1
    return x - 2**bits if x >> (bits - 1) else x


def mark_of(h, samples):
    return (h + 2**32) // (2**33 // samples)


@pytest.fixture(scope="module")
def spark_hash(spark):
    """Spark's hash of a binary, or of two longs or a list of longs; many at once."""

    def of(values, kind):
        if not values:
            return []
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
        h = F.xxhash64("v.a", "v.b") if kind.startswith("struct") else F.xxhash64("v")
        return [r[0] for r in df.orderBy("i").select(h).collect()]

    return of


def brute(texts, spark_hash, k=8, tuple_size=2, samples=64):
    """The same law, without shortcuts: all occurrence-numbered k-mers on the circle, successors of each mark."""
    grams = [[t[i : i + k] for i in range(max(1, len(t) - k + 1))] for t in (x.encode() for x in texts)]
    flat = sorted({g for own in grams for g in own})
    low33 = dict(zip(flat, [signed(h << 31) >> 31 for h in spark_hash([bytearray(g) for g in flat], "binary")]))
    placed, pairs = [], {}
    for own in grams:
        seen, out = {}, []
        for i, g in enumerate(own):
            h = low33[g]
            seen[h] = seen.get(h, -1) + 1
            out.append((h, seen[h], i + 1))
            if seen[h]:
                pairs[h, seen[h]] = None
        placed.append(out)
    keys = list(pairs)
    for key, v in zip(keys, spark_hash(keys, "struct<a:bigint,b:int>")):
        pairs[key] = v
    step, prints = 2**33 // samples, []
    lists = []
    for own in placed:
        circle = []
        for h, o, place in own:
            if o:
                h = (signed(pairs[h, o]) >> 31) // step * step + h % step
            circle.append((h, place))
        circle.sort()
        for j in range(samples):
            start = sum(h < j * step - 2**32 for h, _ in circle)
            members = [circle[(start + r) % len(circle)] for r in range(tuple_size)]
            lists.append([h % 2**31 for h, _ in sorted(members, key=lambda m: m[1])])
    hashes = spark_hash(lists, "array<bigint>")
    for i in range(len(texts)):
        prints.append("".join(f"{h % 2**32:08X}" for h in hashes[i * samples : (i + 1) * samples]))
    return prints


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta of the and to in é 漢字".split()) + str(rng.randrange(40)) for _ in range(n))


def test_equals_a_version_without_shortcuts(spark, spark_hash):
    rng = random.Random(2)
    texts = ["a", "short", "exactly8", "nine char", "same " * 700, "ab" * 3000, words(rng, 30), words(rng, 900), "naïve 漢字 " * 200, words(rng, 2500), "x" * 5000 + words(rng, 50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(order_minhash(F.col("text"))).collect()]
    assert got == brute(texts, spark_hash)
    got = [r[0] for r in df.orderBy("i").select(order_minhash(F.col("text"), 5, 3, 16)).collect()]
    assert got == brute(texts, spark_hash, 5, 3, 16)


def test_likeness_falls_with_edits_and_with_order(spark):
    rng = random.Random(5)
    base = [words(rng, 8) for _ in range(60)]
    few, moved = list(base), base[30:] + base[:30]
    for i in range(0, 60, 20):
        few[i] = words(rng, 8)
    shuffled = list(base)
    rng.shuffle(shuffled)
    rows = [(k, " ".join(v)) for k, v in (("base", base), ("few", few), ("moved", moved), ("shuffled", shuffled), ("other", [words(rng, 8) for _ in range(60)]))]
    df = spark.createDataFrame(rows, "k string, text string").withColumn("f", order_minhash(F.col("text"), samples=256))
    own = df.where("k = 'base'").select(F.col("f").alias("g"))
    near = {r["k"]: r["near"] for r in df.join(own).select("k", likeness(F.col("f"), F.col("g")).alias("near")).collect()}
    assert near["base"] == 1 and near["few"] > near["moved"] > near["shuffled"] > near["other"] and near["few"] > 0.7


def expected(rows):
    """(doc_id, n_chars, sha, next text) in the operator's order, without the ties."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest(), u))
    return out


@pytest.mark.parametrize("per_bucket", [3, 5, 10**6])
def test_next_document(spark, corpus, per_bucket, monkeypatch):
    monkeypatch.setattr(om.with_next, "__defaults__", (per_bucket,))
    unique = {r[0]: r[1] for r in corpus if r[0] is not None}
    rows = [*unique.items(), (None, "no id"), (-5, "𝒳 beyond"), (2**62, "far")]
    df = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, fingerprint string, tie double").repartition(5)
    got = edited_fingerprints(df).withColumn("sha", F.sha2("edited_text", 256)).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    true = {e[0]: e for e in expected(rows)}
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        i, n, sha, following = true[r["doc_id"]]
        assert (r["n_chars"], r["sha"]) == (n, sha)
        assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] == "") == (not texts[i])
        if following == (texts[i] or ""):
            assert r["near_next"] == 1
    assert len({t: p for t, p in ((texts[i] or "", p) for i, p in prints.items())}) == len({(texts[i] or "", p) for i, p in prints.items()})


def test_repeated_ids_fill_buckets(spark, monkeypatch):
    rows = [(7 if i % 3 else i, f"text {i % 50} " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = {}
    for size in (4, 1000):
        monkeypatch.setattr(om.with_next, "__defaults__", (size,))
        order[size] = sorted((r["doc_id"], r["edited_text"], r["near_next"]) for r in edited_fingerprints(df).collect())
    assert order[4] == order[1000] and len(order[4]) == 300


def test_odd_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert edited_fingerprints(nothing).count() == 0
    one = edited_fingerprints(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first()
    assert one["edited_text"] == "alonealone" and one["near_next"] == 1
    none = edited_fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r["n_chars"], r["near_edited"], r["near_next"], r["fingerprint"]) for r in none] == [(0, 1, 1, "")] * 2
    assert fingerprints(spark.createDataFrame([(1, "a text")], "doc_id long, text string")).first()["n_chars"] == 6
