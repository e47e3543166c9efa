from collections import Counter

import numpy as np
import pytest

from tablewright.llm.mixing import cyclic_weights, fair_targets, mixed_stream, weighted_fair_mix
from tablewright.llm.sharding import assign_shards, jump_hash


def test_new_shard_takes_its_share_and_nothing_else_moves():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 20_000)
    for n in (1, 2, 7, 40):
        before, after = jump_hash(keys, n), jump_hash(keys, n + 1)
        moved = before != after
        assert (after[moved] == n).all() and before.max() < n and before.min() >= 0
        assert abs(moved.mean() - 1 / (n + 1)) < 0.02
        counts = np.bincount(before, minlength=n)
        assert counts.max() < 1.4 * 20_000 / n


def test_slots_have_no_gaps(documents, corpus):
    rows = assign_shards(documents, 7, buckets=3).collect()
    assert len(rows) == len(corpus)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    sizes = Counter((r["doc_id"], r["size"]) for r in rows)
    assert sizes == Counter((i, len((t or "").encode()) + 16) for i, t, *_ in corpus)
    assert all(r["grown_shard"] in (r["shard"], 7) for r in rows)
    again = assign_shards(documents.repartition(2), 7, buckets=3).select("doc_id", "text_crc32", "shard", "slot").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)


def water(sizes, weights, budget, most=3):
    """Targets by bisection of the common level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, most * s) for s, w in zip(sizes, weights)) < budget else (low, level)
    return [min(w * low, most * s) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 40, 3000], [0, 10, 90], [1, 1, 1, 10_000]])
def test_targets(spark, sizes):
    sources = spark.createDataFrame([(False, f"s{k}", s) for k, s in enumerate(sizes)], "__none boolean, __name string, source_size long")
    rows = fair_targets(cyclic_weights(sources), sum(sizes)).orderBy("__name").collect()
    assert [r["weight"] for r in rows] == [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    assert [r["target"] for r in rows] == pytest.approx(water(sizes, [r["weight"] for r in rows], sum(sizes)), abs=1e-6)


def test_sources_meet_their_targets(documents, corpus):
    rows = weighted_fair_mix(documents, parts=4).collect()
    assert len(rows) == len(corpus) and sum(r["size"] for r in rows) == sum(len((t or "").split()) for _, t, *_ in corpus)
    by = {}
    for r in rows:
        assert r["taken"] in [k * r["size"] for k in range(4)]
        by.setdefault(r["source"], []).append(r)
    assert None in by
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6
    again = weighted_fair_mix(documents.repartition(7), parts=4, keep_text=False).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in again) == Counter((r["doc_id"], r["size"], r["taken"]) for r in rows)


def test_stream_serves_every_source_all_along(documents):
    mixed = weighted_fair_mix(documents.drop("doc"), parts=4)
    stream = mixed_stream(mixed, documents.columns[:5]).collect()
    assert len(stream) == mixed.groupBy().sum("copies").first()[0]
    assert Counter(r["doc_id"] for r in stream)[80] == mixed.where("doc_id = 80").first()["copies"]


def test_nothing_in_nothing_out(nothing):
    assert assign_shards(nothing, 4).count() == 0
    assert weighted_fair_mix(nothing).count() == 0
