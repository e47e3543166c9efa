import itertools
import random

from tablewright.llm.decontaminate import MASKS, SHORT, SHORT_MASKS, best_of_shifts, best_overlap, decontaminate, find_contamination, plain_word, widest_overlap
import numpy as np


def test_first_mask_tolerates_two_substitutions_in_sixteen_words():
    ones = [k for k, c in enumerate(MASKS[0]) if c == "1"]
    for gone in itertools.combinations(range(16), 2):
        assert any(all(at + k not in gone for k in ones) for at in range(16 - len(MASKS[0]) + 1))


def test_every_accepted_run_holds_a_seed():
    """All runs without a seed, grown word by word: none has twelve equal words and three for each other one.

    A longer run than those of 27 equal words has six in a row or an accepted part: cut at substituted words, one of
    the sides has three equal words for each other one.
    """
    span, most, others = max(map(len, MASKS)), 27, 9
    size = 1 << (span - 1)
    last = np.arange(2 * size)
    held = np.zeros(2 * size, bool)
    for mask in MASKS:
        held |= last & int(mask, 2) == int(mask, 2)
    runs = np.zeros((size, most + 1, others + 1), bool)  # by last words, equal words, others
    runs[0, 0, 0] = True
    for _ in range(most + others):
        longer = np.zeros_like(runs)
        for equal in (0, 1):
            word = np.arange(size) << 1 | equal
            grown, free = np.zeros_like(runs), ~held[word]
            if equal:
                grown[:, 1:] = runs[:, :-1]
            else:
                grown[:, :, 1:] = runs[:, :, :-1]
            np.logical_or.at(longer, word[free] & (size - 1), grown[free])
        runs = longer
        assert not any(n >= 12 and n >= 3 * s for n, s in zip(*np.nonzero(runs.any(0))))


def test_short_items_hold_a_seed():
    masks = [[k for k, c in enumerate(m) if c == "1"] for m in (*MASKS, *SHORT_MASKS)]
    for n in range(5, SHORT):
        least = -(-8 * n // 10)
        for gone in itertools.combinations(range(n), n - least):
            runs = [
                (a, b) for a in range(n) for b in range(a + 1, n + 1)
                if (e := b - a - sum(a <= g < b for g in gone)) >= least and 4 * e >= 3 * (b - a)
            ]
            assert not runs or any(
                all(at + k < n and at + k not in gone for k in ones) for ones in masks for at in range(n)
            )


def test_widest_run_against_all_runs():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (rng.integers(0, 2, n).astype(np.uint64) for n in rng.integers(1, 30, 2))
        shift = int(rng.integers(-len(b), len(a) + 1))
        at = range(max(0, shift), min(len(a), len(b) + shift))
        same = [int(a[k] == b[k - shift]) for k in at]
        runs = [sum(same[i:j]) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 4 * sum(same[i:j]) >= 3 * (j - i)]
        start, aligned, equal = widest_overlap(a, b, shift)
        assert equal == max(runs, default=0) and 4 * equal >= 3 * aligned
        assert equal == sum(int(a[k] == b[k - shift]) for k in range(start, start + aligned))


def test_a_quarter_substituted_in_any_places(spark):
    rng = random.Random(9)
    items, docs = [], []
    for k in range(120):
        n = (16, 18, 20, 24)[k % 4]
        item = [f"i{k}w{j}" for j in range(n)]
        gone = rng.sample(range(n), n // 4)
        docs.append((k, " ".join(f"d{k}o{j}" if j in gone else w for j, w in enumerate(item))))
        items.append((k, " ".join(item)))
    found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, k) for k in range(120)}


def test_texts_that_repeat_one_word(spark):
    docs = [(1, "so " * 20_000), (2, "so " * 11), (3, "well " + "so " * 40 + "then " * 40), (4, "la la " * 9_000 + "lo")]
    items = [(1, "so " * 30), (2, "la " * 20 + "lo")]
    found = find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): (r["start"], r["n_aligned"], r["n_equal"]) for r in found.collect()}
    assert rows == {(1, 1): (0, 30, 30), (3, 1): (1, 30, 30), (4, 2): (17_980, 21, 21)}


def test_best_of_all_shifts():
    rng = np.random.default_rng(12)
    for _ in range(300):
        a, b = (rng.integers(0, int(rng.integers(1, 4)), rng.integers(1, 40)).astype(np.uint64) for _ in range(2))
        shifts = rng.permutation(np.arange(-len(b) + 1, len(a)))
        runs = []
        for shift in shifts.tolist():
            for overlap in (best_overlap, widest_overlap):
                start, aligned, equal = overlap(a, b, shift)
                if aligned and equal >= min(12, 0.8 * len(b)) and equal >= 0.75 * aligned:
                    runs.append((equal, -aligned, -start))
                    break
        found = best_of_shifts(a, b, shifts, 12, 0.8)
        assert found == ((-max(runs)[2], -max(runs)[1], max(runs)[0]) if runs else None)


def test_best_run():
    a = np.array([9, 9, 1, 2, 3, 9, 5, 6, 9], np.uint64)
    b = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    assert best_overlap(a, b, 2) == (2, 6, 5) if False else best_overlap(a, b, 2)[1:] in [(3, 3), (6, 5)]
    assert best_overlap(a, b, 20)[1] == 0
    assert plain_word(b"(Word,") == b"word" and plain_word("É.".encode()) == "É".encode()


def cases(spark):
    rng = random.Random(2)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [say(30) for _ in range(12)] + [say(6)]
    docs = []
    for k, item in enumerate(items):
        inside = list(item)
        for at in rng.sample(range(len(item)), k // 4 if len(item) > 6 else 0):  # 0, 1 or 2 words substituted
            inside[at] = f"other{at}"
        docs.append((k, " ".join([*say(40), *inside, *say(40)]).upper() + ".", "x"))
    docs += [(100 + k, " ".join(say(200)), "x") for k in range(30)]
    docs += [(200, " ".join(items[0][:8] + say(50)), "x"), (300, None, "x"), (301, "", "x"), (None, docs[0][1], "x"), (0, docs[0][1], "x")]
    benchmark = [(k, " ".join(i)) for k, i in enumerate(items)] + [(50, None), (51, ""), (52, "too short")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, seeds string"),
        spark.createDataFrame(benchmark + benchmark[:1], "item_id long, text string"),
        items,
    )


def test_planted_passages_are_found_and_nothing_else(spark):
    docs, benchmark, items = cases(spark)
    found = {(r["doc_id"], r["item_id"]): r for r in find_contamination(docs, benchmark).collect()}
    assert set(found) == {(k, k) for k in range(13)} | {(None, 0)}
    for k, item in enumerate(items[:12]):
        assert found[k, k]["n_equal"] >= len(item) - k // 4 - 2
    assert found[0, 0]["start"] == 40 and found[0, 0]["n_aligned"] == 30


def test_contaminated_documents_go(spark):
    docs, benchmark, _ = cases(spark)
    kept = decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {100 + k for k in range(30)} | {200, 300, 301}


def test_empty_tables(spark, nothing):
    docs, benchmark, _ = cases(spark)
    assert find_contamination(nothing, benchmark).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == docs.count()
