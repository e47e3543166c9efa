import random
import re
from collections import Counter

import pytest

from tablewright.llm import collocations as co
from tablewright.llm.collocations import collocations, phrase_counts


def pieces(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute_counts(rows, longest):
    out, total = Counter(), Counter()
    for lang, text in rows:
        for ws in pieces(text):
            total[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                out.update((lang or "und", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    return out, {k: v for k, v in total.items() if v}


def brute(rows, longest=3, least=10, top=2000, percent=50):
    f, total = brute_counts(rows, longest)
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in cands.items():
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(
            other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= percent * a
            for (other, q), b in cands.items()
        )
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], k))
    return {
        (lang, n + 1, p.decode(), -a, l, r, total[lang], -s, k)
        for lang, own in found.items()
        for n, (s, a, p, l, r, k) in enumerate(sorted(own)[:top])
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "Of", "new", "york", "city", "é", "漢", "x-1", "(a)", "\x00", "z\x85z"]
    out = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None]), text))
    out += [("en", None), (None, None), ("en", ""), ("fr", " \n . "), ("und", "new york " * 5), ("en", "same " * 4000), ("de", "y" * 100_000)]
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "a", 1.0, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n double, depth int").repartition(6)


@pytest.mark.parametrize("longest, memory", [(3, 1 << 21), (3, 200), (2, 50), (4, 300)])
def test_all_counts(table, rows, longest, memory):
    got = {(r["lang"], r["phrase"], r["depth"]): r["n"] for r in phrase_counts(table, longest, memory=memory).collect()}
    counts, totals = brute_counts(rows, longest)
    assert {k: v for k, v in got.items() if k[2]} == {(lang, " ".join(p), len(p)): n for (lang, p), n in counts.items()}
    assert {k[0]: v for k, v in got.items() if not k[2]} == totals


@pytest.mark.parametrize("longest, least, top, memory", [(3, 10, 2000, 1 << 21), (3, 3, 7, 100), (4, 2, 50, 500)])
def test_ranked(table, rows, longest, least, top, memory):
    got = collocations(table, longest, least, top, memory=memory).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect()
    assert {tuple(r) for r in got} == brute(rows, longest, least, top)
    assert len(got) == len({tuple(r) for r in got})


def test_suffixes_are_sent_off_early(table, rows, monkeypatch):
    monkeypatch.setattr(co, "HELD", 500)
    monkeypatch.setattr(co, "WORDS_HELD", 6)
    step = co._stretches
    monkeypatch.setattr(co, "_stretches", lambda data: step(data, 100))
    batches = table.select("lang", "text").na.fill({"lang": "und", "text": ""}).toArrow().to_batches()
    found = Counter()
    for lang, own in co._by_language(iter(batches), 3):
        leaves, counts = own.leaves(3)
        names = list(own.numbers)
        for leaf, n in zip(leaves, counts):
            p = [names[i].decode() for i in leaf if i]
            found.update({(lang, tuple(p[:m])): int(n) for m in range(1, len(p) + 1)})
    assert found == brute_counts(rows, 3)[0]


def test_empty(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(nothing).count() == 0 and phrase_counts(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert collocations(blank).count() == 0
