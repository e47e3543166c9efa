"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the tasks that score."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder
from .tokens import LOWER, WordHashes, mix, signed, texts_of

#: Hash of the mark after a text; words hash to anything else but by chance.
END = 2
#: Tokens that a task holds before it counts or looks them up.
HELD = 1 << 20
#: Tokens for each part of the model.
PART_TOKENS = 4_000_000


def local_path(path: str) -> str:
    """The shared folder as the file system of every executor shows it; arrays are mapped from there."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{path}: arrays are memory-mapped, so the shared folder must be mounted on all executors")
    return parsed.path


def _save(path: str, array: np.ndarray) -> None:
    """A task that runs again, or twice at once, leaves one whole file."""
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as file:
        np.save(file, array)
    os.replace(own, path)


class Stream:
    """Token hashes of texts: words in lower case, then the end."""

    def __init__(self):
        self.words = WordHashes()

    def of(self, data: bytes) -> np.ndarray:
        words = data.translate(LOWER).split()
        out = np.empty(len(words) + 1, np.uint64)
        out[:-1] = self.words.of(words)
        out[-1] = END
        return out


def _groups(batches: Iterator[pa.RecordBatch], stream: Stream):
    """Lists of texts' tokens, about HELD tokens at a time; a text is never cut."""
    held, size = [], 0
    for batch in batches:
        for data in texts_of(batch):
            held.append(stream.of(data))
            size += len(held[-1])
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counts_of(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values = values[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[start], np.add.reduceat(counts[order], start) if len(start) else counts[:0]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counts_of(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _partial_counts(values_of, part_of, n_parts: int):
    """(part, value, count) rows of a task; counts are merged until 4 HELD different values are there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_from, parts, size = values_of(), [], 0

        def out():
            values, counts = _merged(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array(part_of(values, n_parts)), pa.array(signed(values)), pa.array(counts)], ["part", "value", "n"]
            )

        for held in _groups(batches, Stream()):
            values = values_from(held)
            parts.append(_counts_of(values, np.ones(len(values), np.int64)))
            size += len(parts[-1][0])
            if len(parts) > 3 or size > 4 * HELD:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > 4 * HELD:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    return rows


def _word_values():
    return np.concatenate


class Vocabulary:
    """Words' hashes in sorted arrays, one for each part of the hash range; a word's id is its place."""

    def __init__(self, folder: str, offsets: list[int]):
        self.hashes = [np.load(f"{folder}/words-{k}.npy", mmap_mode="r") for k in range(len(offsets))]
        self.offsets = offsets

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for those that are not there."""
        out = np.full(len(hashes), -1, np.int64)
        part = _range_part(hashes, len(self.hashes))
        edges = np.searchsorted(part, np.arange(len(self.hashes) + 1))
        for k, own in enumerate(self.hashes):
            asked = hashes[edges[k] : edges[k + 1]]
            if len(asked) and len(own):
                at = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                out[edges[k] : edges[k + 1]] = np.where(own[at] == asked, at + self.offsets[k], -1)
        return out


def _range_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts cut the range of hashes evenly, so parts in order are hashes in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _pair_part(pairs: np.ndarray, parts: int) -> np.ndarray:
    return _range_part(mix(pairs), parts)


def _ids_of(held: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(id before, id) of each token; the begin has the id after all words', an unknown word has -1."""
    tokens = np.concatenate(held)
    unique, inverse = np.unique(tokens, return_inverse=True)
    ids = vocabulary.ids(unique)[inverse]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    ends = np.cumsum([len(h) for h in held])
    before[np.r_[0, ends[:-1]]] = vocabulary.offsets[-1] + len(vocabulary.hashes[-1])
    return before, ids


def _pair_values(folder: str, offsets: list[int]):
    def build():
        vocabulary = Vocabulary(folder, offsets)

        def values(held: list[np.ndarray]) -> np.ndarray:
            before, ids = _ids_of(held, vocabulary)
            return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)

        return values

    return build


def _write_parts(folder: str, name: str):
    """Sorted arrays from rows (part, value, n) that come sorted; one row back for each part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"value": [], "n": []}
        last = None

        def out(part: int):
            value, n = np.concatenate(held["value"]), np.concatenate(held["n"])
            _save(f"{folder}/{name}-{part}.npy", value.view(np.uint64))
            _save(f"{folder}/{name}_n-{part}.npy", n.astype(np.uint32 if n.max() < 2**32 else np.uint64))
            found = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=5)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (part, len(value), int(n.sum()), *found[1:5].tolist())],
                ["part", "size", "total", "n1", "n2", "n3", "n4"],
            )

        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if last is not None and part[a] != last:
                    yield out(last)
                    held = {"value": [], "n": []}
                last = int(part[a])
                for k in held:
                    held[k].append(batch.column(k).to_numpy()[a:b])
        if last is not None:
            yield out(last)

    return rows


def _pair_facts(folder: str, starts: list[int]):
    """From the pairs of a part: kinds of followers by word before, and kinds of words before by word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("id").to_pylist():
                pairs = np.load(f"{folder}/pairs-{part}.npy", mmap_mode="r")
                if not len(pairs):
                    continue
                n = np.asarray(np.load(f"{folder}/pairs_n-{part}.npy", mmap_mode="r")).astype(np.int64)
                before = (pairs >> np.uint64(32)).astype(np.int64)
                start = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
                sums = [np.add.reduceat(x.astype(np.int64), start) for x in (n, n == 1, n == 2, n > 2)]
                word, kinds = np.unique(pairs & np.uint64(2**32 - 1), return_counts=True)
                zeros, none = np.zeros(len(word), np.int64), np.zeros(len(start), np.int64)
                ids = np.r_[before[start], word.astype(np.int64)]
                own = np.searchsorted(starts, ids, "right") - 1
                columns = [own, ids - np.array(starts)[own]]
                columns += [np.r_[x, zeros] for x in sums]
                columns.append(np.r_[none, kinds.astype(np.int64)])
                for at in range(0, len(columns[0]), HELD):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[at : at + HELD]) for c in columns], ["part", "at", "total", "k1", "k2", "k3", "kinds"]
                    )

    return rows


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; plain values where those are missing."""
    if not n1 or not n2 or not n3 or not n4:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(d, 0.01), k) for k, d in enumerate(found, 1))


def _write_words(folder: str, d1: float, d2: float, d3: float):
    """Arrays by word id, one file for each part of the vocabulary: weight left to the lower order, total, kinds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out(part: int):
            at, total, k1, k2, k3, kinds = np.concatenate(held, axis=1)
            size = len(np.load(f"{folder}/words-{part}.npy", mmap_mode="r")) if os.path.exists(f"{folder}/words-{part}.npy") else 1
            left, totals, all_kinds = np.ones(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
            seen = total > 0
            left[at[seen]] = ((d1 * k1 + d2 * k2 + d3 * k3)[seen]) / total[seen]
            totals[at], all_kinds[at] = total, kinds
            for name, array in (("left", left), ("total", totals), ("kinds", all_kinds)):
                _save(f"{folder}/{name}-{part}.npy", array)
            found = np.bincount(np.minimum(kinds, 5), minlength=5)
            more = int((kinds > 2).sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([int(x)], pa.int64()) for x in (part, kinds.sum(), *found[1:5], more)],
                ["part", "kinds", "n1", "n2", "n3", "n4", "more"],
            )

        for batch in batches:
            part = batch.column("part").to_numpy()
            columns = np.stack([batch.column(c).to_numpy() for c in ("at", "total", "k1", "k2", "k3", "kinds")])
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if last is not None and part[a] != last:
                    yield out(last)
                    held = []
                last = int(part[a])
                held.append(columns[:, a:b])
        if last is not None:
            yield out(last)

    return rows


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    offsets: list[int]
    pair_parts: int
    tokens: int
    words: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    kinds: int
    word_left: float


def train(texts: DataFrame, folder: str | None = None, column: str = "text") -> Model:
    """Count the words and word pairs of all texts and write the model's arrays.

    Words are counted first: their sorted hashes are the vocabulary, and a word's id is its place there.
    Then pairs of ids are counted. Both counts are merged in each task before the shuffle and land in parts by hash, so
    a frequent word is one number of one part; the number of parts grows with the tokens. Kinds of
    followers and of words before (continuation counts) are summed from the parts' arrays. Tasks write to a
    file of their own and rename it, so a lost executor costs its tasks and nothing else.
    """
    spark = texts.sparkSession
    path = scratch_folder(spark, "model") if folder is None else folder
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    texts = texts.select(F.col(column).alias("text"))

    def written(values_of, part_of, parts: int, name: str):
        """Count, sum, sort and write the values of all texts in parts."""
        rows = texts.mapInArrow(_partial_counts(values_of, part_of, parts), "part long, value long, n long")
        dealt = rows.repartition(parts, "part").groupBy("part", "value").agg(F.sum("n").alias("n"))
        # the arrays are sorted as unsigned numbers
        dealt = dealt.sortWithinPartitions("part", F.col("value").bitwiseXOR(F.lit(-(2**63))))
        return (
            dealt.mapInArrow(_write_parts(folder, name), "part long, size long, total long, n1 long, n2 long, n3 long, n4 long")
            .groupBy("part").agg(*[F.max(c).alias(c) for c in ("size", "total", "n1", "n2", "n3", "n4")])
            .orderBy("part")
            .collect()  # a row of counts for each part
        )

    length = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, length // 6 // PART_TOKENS + 1)
    found = written(_word_values, _range_part, parts, "words")
    by_part = {r["part"]: r for r in found}
    sizes = [by_part[k]["size"] if k in by_part else 0 for k in range(parts)]
    for k in range(parts):
        if k not in by_part:
            _save(f"{folder}/words-{k}.npy", np.zeros(0, np.uint64))
            _save(f"{folder}/words_n-{k}.npy", np.zeros(0, np.uint32))
    offsets = [0, *np.cumsum(sizes).tolist()][:-1]
    total_words, tokens = sum(sizes), sum(r["total"] for r in found)
    if total_words >= 2**31:
        raise ValueError("pairs of ids hold vocabularies of up to 2**31 words")

    pair_parts = 4 * parts
    found = written(_pair_values(folder, offsets), _pair_part, pair_parts, "pairs")
    pair_counts = [sum(r[f"n{k}"] for r in found) for k in (1, 2, 3, 4)]
    pair_discounts = _discounts(*pair_counts)

    for k in set(range(pair_parts)) - {r["part"] for r in found}:
        _save(f"{folder}/pairs-{k}.npy", np.zeros(0, np.uint64))
        _save(f"{folder}/pairs_n-{k}.npy", np.zeros(0, np.uint32))
    facts = (
        spark.range(0, pair_parts, 1, min(pair_parts, 10_000))
        .mapInArrow(_pair_facts(folder, [*offsets, total_words]), "part long, at long, total long, k1 long, k2 long, k3 long, kinds long")
        .groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in ("total", "k1", "k2", "k3", "kinds")])
    )
    # the begin has a part of its own after the words'
    summary = (
        facts.repartition(parts + 1, "part").sortWithinPartitions("part")
        .mapInArrow(_write_words(folder, *pair_discounts), "part long, kinds long, n1 long, n2 long, n3 long, n4 long, more long")
        .groupBy("part").agg(*[F.max(c).alias(c) for c in ("kinds", "n1", "n2", "n3", "n4", "more")])
        .collect()
    )
    wrote = {r["part"] for r in summary}
    for k in range(parts + 1):
        if k not in wrote:
            size = sizes[k] if k < parts else 1
            for name, array in (("left", np.ones(size)), ("total", np.zeros(size, np.int64)), ("kinds", np.zeros(size, np.int64))):
                _save(f"{folder}/{name}-{k}.npy", array)
    sums = {c: sum(r[c] for r in summary) for c in ("kinds", "n1", "n2", "n3", "n4", "more")}
    d = _discounts(*(sums[f"n{k}"] for k in (1, 2, 3, 4)))
    left = (d[0] * sums["n1"] + d[1] * sums["n2"] + d[2] * sums["more"]) / sums["kinds"] if sums["kinds"] else 1.0
    model = Model(folder, offsets, pair_parts, int(tokens), total_words, pair_discounts, d, sums["kinds"], left)
    with open(f"{folder}/model.json", "w") as file:
        json.dump(model.__dict__, file)
    return model


def load(folder: str) -> Model:
    with open(f"{local_path(folder)}/model.json") as file:
        return Model(**json.load(file))


class Scorer:
    """Probabilities from the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        load_all = lambda name, n: [np.load(f"{model.folder}/{name}-{k}.npy", mmap_mode="r") for k in range(n)]
        self.vocabulary = Vocabulary(model.folder, model.offsets)
        parts = len(model.offsets)
        self.counts = load_all("words_n", parts)
        self.left, self.total, self.kinds = (load_all(name, parts + 1) for name in ("left", "total", "kinds"))
        self.pairs, self.pair_n = load_all("pairs", model.pair_parts), load_all("pairs_n", model.pair_parts)
        self.starts = np.array([*model.offsets, model.words])

    def by_id(self, arrays: list[np.ndarray], ids: np.ndarray, missing: float) -> np.ndarray:
        """Values of sorted ids; -1 has `missing`."""
        out = np.full(len(ids), missing, np.float64)
        part = np.searchsorted(self.starts, ids, "right") - 1
        edges = np.searchsorted(part, np.arange(len(arrays) + 1))
        for k, own in enumerate(arrays):
            if edges[k + 1] > edges[k]:
                out[edges[k] : edges[k + 1]] = own[ids[edges[k] : edges[k + 1]] - self.starts[k]]
        return out

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted pairs, 0 for those that are not there."""
        out = np.zeros(len(pairs))
        part = _pair_part(pairs, self.m.pair_parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.m.pair_parts + 1))
        for k, own in enumerate(self.pairs):
            asked = order[edges[k] : edges[k + 1]]
            if len(asked) and len(own):
                at = np.minimum(np.searchsorted(own, pairs[asked]), len(own) - 1)
                hit = own[at] == pairs[asked]
                out[asked[hit]] = self.pair_n[k][at[hit]]
        return out

    @staticmethod
    def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return n - np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]

    def log_probabilities(self, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token of some texts, and its count in training."""
        before, ids = _ids_of(held, self.vocabulary)
        words, word_at = np.unique(ids, return_inverse=True)
        kinds, counts = self.by_id(self.kinds[:-1], words, 0.0), self.by_id(self.counts, words, 0.0)
        # lower order: share of all kinds of pairs, with an even share of what the discounts leave
        low = self.m.word_left / (self.m.words + 1)
        if self.m.kinds:
            low = low + self.discounted(kinds, self.m.word_discounts) / self.m.kinds
        low = np.broadcast_to(low, words.shape)[word_at]
        contexts, context_at = np.unique(before, return_inverse=True)
        left = self.by_id(self.left, contexts, 1.0)[context_at]
        total = self.by_id(self.total, contexts, 0.0)[context_at]
        known = (before >= 0) & (ids >= 0)
        n = np.zeros(len(ids))
        pairs, pair_at = np.unique((before[known].astype(np.uint64) << np.uint64(32)) | ids[known].astype(np.uint64), return_inverse=True)
        n[known] = self.pair_counts(pairs)[pair_at]
        high = np.divide(self.discounted(n, self.m.pair_discounts), total, out=np.zeros(len(n)), where=total > 0)
        return np.log10(high + left * low), counts[word_at]


def _score_rows(model: Model, columns: list[str]):
    names = [*columns, "n_tokens", "n_known", "base_score", "score"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, stream = Scorer(model), Stream()
        floor = model.tokens + 0.5 * (model.words + 1)
        for batch in batches:
            done = []
            for held in _groups(iter([batch]), stream):
                logs, counts = scorer.log_probabilities(held)
                start = np.r_[0, np.cumsum([len(h) for h in held])[:-1]]
                base = np.log10((counts + 0.5) / floor)
                sums = [np.add.reduceat(x, start) for x in ((counts > 0).astype(np.int64), base, logs)]
                done.append((np.array([len(h) for h in held]), *sums))
            if done:
                values = [np.concatenate(v) for v in zip(*done)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *[pa.array(v) for v in values]], names)

    return rows


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`: id, n_tokens, n_known, base_score, score, perplexity.

    `score` is the model's log10 probability of the text with its end; `base_score` that of single
    words with half a count added to each. A missing or empty text has one token, its end. Ids may repeat or be missing;
    other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).mapInArrow(
        _score_rows(model, ["__id"]),
        f"__id {dict(df.dtypes)[id_col]}, n_tokens long, n_known long, base_score double, score double",
    )
    return rows.withColumnRenamed("__id", id_col).withColumn("perplexity", F.pow(10.0, -F.col("score") / F.col("n_tokens")))


def training_split(df: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 1) -> DataFrame:
    """`df` with held_out: crc32 of the id as text falls on the held fold; a missing id counts as the text 'null'."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return df.withColumn("held_out", F.crc32(key.cast("binary")) % folds == held)
