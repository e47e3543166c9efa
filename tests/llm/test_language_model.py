import math
import zlib
from collections import Counter, defaultdict

import pytest

from tablewright.llm.language_model import _discounts, load, score, train, training_split


def brute(train_texts, texts):
    lower = {c: c + 32 for c in range(65, 91)}
    tokens = lambda t: [*(t or "").translate(lower).encode().split(), None]
    words, pairs = Counter(), Counter()
    for t in map(tokens, train_texts):
        words.update(t)
        pairs.update(zip(["begin", *t[:-1]], t))
    total, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
        before[b] += 1
    by = lambda counts: [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    d, e = (0.0, *_discounts(*by(pairs.values()))), (0.0, *_discounts(*by(before.values())))
    every = sum(before.values())
    left = sum(e[min(n, 3)] for n in before.values()) / every

    def low(w):
        return (before[w] - e[min(before[w], 3)]) / every + left / (len(words) + 1)

    def probability(a, w):
        if not total[a]:
            return low(w)
        n = pairs[a, w]
        return (n - d[min(n, 3)]) / total[a] + sum(d[k] * c for k, c in kinds[a].items()) / total[a] * low(w)

    n, v = sum(words.values()), len(words)
    out = {}
    for t in texts:
        x = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)
        out[t] = (len(x), sum(words[w] > 0 for w in x), base, sum(math.log10(probability(a, w)) for a, w in zip(["begin", *x[:-1]], x)))
    assert sum(probability("begin", w) for w in words) + probability("begin", "never seen") == pytest.approx(1)
    return n, out


def test_scores(documents, corpus, spark):
    docs = training_split(documents)
    model = train(docs.where("not held_out"))
    rows = score(docs, model).collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 == 1
    n, expected = brute([t for i, t, *_ in corpus if not held(i)], {t for _, t, *_ in corpus})
    assert model.tokens == n and len(rows) == len(corpus)
    texts = defaultdict(set)
    for i, t, *_ in corpus:
        texts[i].add(t)
    for r in rows:
        close = [pytest.approx(expected[t], rel=1e-9) == (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for t in texts[r["doc_id"]]]
        assert any(close)
    assert load(model.folder).__dict__ == {**model.__dict__, "pair_discounts": list(model.pair_discounts), "word_discounts": list(model.word_discounts)}


def test_held_out_texts_are_likelier_than_by_words_alone(tables):
    docs = training_split(tables("documents"))
    rows = training_split(score(docs, train(docs.where("not held_out")))).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert rows[0] > rows[1]


def test_empty_tables(documents, nothing):
    empty = train(nothing)
    assert empty.tokens == 0
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in score(nothing.union(documents.where("doc_id = 70")), empty).collect())
    assert score(nothing, empty).count() == 0
