from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.components import connected_components
from pyspark.sql import functions as F

from tablewright.llm.jaccard_join import _joined, common_grams, jaccard_join, jaccard_links, keep_one_of_each, prefix_length, suffix_filter

LAST = 2**63 - 1


def shingle_sets(corpus, n):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for i, t, *_ in corpus:
        w = (t or "").translate(lower).encode().split()
        sets.append((LAST if i is None else i, frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()))
    return sets


def linked(x, y, percent):
    return x and y and 100 * len(x & y) >= percent * len(x | y)


def brute(corpus, percent, n):
    sets = shingle_sets(corpus, n)
    group = list(range(len(sets)))
    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            same_row = not x and not y and sets[a][0] == sets[b][0] and (corpus[a][1] or "") == (corpus[b][1] or "")
            if same_row or linked(x, y, percent):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(sets, group):
        low[g] = min(i, low.get(g, i))
    shown = lambda i: None if i == LAST else i
    return Counter((shown(i), len(x), shown(low[g])) for (i, x), g in zip(sets, group))


@pytest.mark.parametrize(("percent", "shingle", "rounds"), [(90, 3, 3), (80, 5, 1), (60, 2, 0)])
def test_components(documents, corpus, percent, shingle, rounds):
    found = jaccard_join(documents, percent, shingle, rounds=rounds).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in found) == brute(corpus, percent, shingle)


@pytest.mark.parametrize(("percent", "shingle", "block"), [(90, 3, None), (80, 5, 700), (60, 2, 150), (100, 3, 1)])
def test_every_link_is_counted(documents, corpus, percent, shingle, block):
    sets = shingle_sets(corpus, shingle)
    expected = Counter(
        (None if i == LAST else i, len(x), sum(bool(linked(x, y, percent)) for b, (_, y) in enumerate(sets) if a != b)) for a, (i, x) in enumerate(sets)
    )
    if block is None:
        found = jaccard_join(documents, percent, shingle)
    else:  # components are cut into many blocks
        joined = _joined(documents, percent, shingle, "doc_id", "text", 1)
        found = joined.rows(joined.links(as_pairs=False, block=block)).select(
            F.expr(f"nullif(doc, {LAST})").alias("doc_id"), F.col("n").alias("n_shingles"), "n_links"
        )
    assert Counter(tuple(r) for r in found.select("doc_id", "n_shingles", "n_links").collect()) == expected
    assert max(n for _, _, n in expected) > 1


def test_links_of_classes(documents, corpus, nothing):
    low = {}
    for i, x in shingle_sets(corpus, 5):
        low[x] = min(i, low.get(x, i))
    expected = Counter(
        tuple(sorted((i, j))) for x, i in low.items() for y, j in low.items() if x != y and (i, sorted(x)) < (j, sorted(y)) and linked(x, y, 60)
    )
    found = jaccard_links(documents, 60)
    assert Counter((a, LAST if b is None else b) for a, b in found.collect()) == expected and expected
    assert jaccard_links(nothing).count() == 0


def test_one_row_of_each_component_stays(documents, corpus):
    kept = keep_one_of_each(documents)
    assert kept.columns == documents.columns
    groups = {(c, n > 0 or (i, n)) for i, n, c in brute(corpus, 80, 5)}
    assert kept.count() == len(groups) + 1  # two texts share the id 6
    assert kept.where("doc_id = 5").count() == 1


def test_chains_reach_the_smallest(spark):
    links = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (700, 700)]
    nodes = [(k,) for k in [*range(201), 500, 501, 700, 900]]
    found = connected_components(spark.createDataFrame(links, "low long, high long"), spark.createDataFrame(nodes, "cls long"))
    expected = {k: 0 for k in range(201)} | {500: 500, 501: 500, 700: 700, 900: 900}
    assert dict(map(tuple, found.collect())) == expected


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.sampled_from([60, 80, 90]))
def test_filters_lose_no_pair(a, b, percent):
    shared = len(a & b)
    if 100 * shared < percent * len(a | b):
        return
    least = min(common_grams(len(a)), common_grams(len(b)))
    x, y = (set(sorted(s)[: prefix_length(len(s), percent)]) for s in (a, b))
    assert len(x & y) >= least
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    need = -(-percent * (len(a) + len(b)) // (100 + percent))
    assert suffix_filter(x, y, len(a) + len(b) - 2 * need)


def test_nothing_in_nothing_out(nothing):
    assert jaccard_join(nothing).count() == 0
    assert keep_one_of_each(nothing).count() == 0
