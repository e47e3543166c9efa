"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .filters import hash_filter, passes
from .tokens import LOWER, WordHashes, list_array, mix, order_id, signed, text_hash, texts_of

#: 1: the word counts, 0: any word. In every run of twelve or more equal words with a quarter of its words
#: substituted in any places at least one mask fits (tests/llm/test_decontaminate.py goes through all).
MASKS = ("111011", "1100001011", "111100001", "11111")
#: Items with fewer words than SHORT need fewer equal words; for these the short masks are used as well.
SHORT, SHORT_MASKS = 14, ("1111", "11011", "10111", "11101")
#: Items with fewer words match nothing.
LEAST_WORDS = 5
_OUTER = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


def plain_word(word: bytes) -> bytes:
    """Lower case without punctuation around it."""
    return _OUTER.sub(b"", word.translate(LOWER))


class Seeds:
    """Spaced seeds of a text: hashes of the words that a mask lets through, at every place."""

    def __init__(self, short: bool = True):
        masks = (*MASKS, *SHORT_MASKS) if short else MASKS
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in masks]
        self.spans = [len(m) for m in masks]
        self.words = WordHashes(plain_word)
        self.factors = [np.random.default_rng(k).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1) for k in range(len(masks))]

    def hashes(self, text: bytes) -> np.ndarray:
        """A number for each word."""
        return self.words.of(text.split())

    def of(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hashes, places) for each mask; none for a text shorter than the mask."""
        for shape, span, factors in zip(self.masks, self.spans, self.factors):
            n = max(0, len(x) - span + 1)
            total = np.zeros(n, np.uint64)
            for k, at in enumerate(shape):
                total += x[at : at + n] * factors[k]
            yield mix(total), np.arange(n)


def _benchmark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = Seeds()
    for batch in batches:
        items, masks, hashes, places = [], [], [], []
        for item, data in zip(batch.column("item").to_pylist(), texts_of(batch)):
            x = seeds.hashes(data)
            if len(x) < LEAST_WORDS:
                continue
            for k, (h, at) in enumerate(seeds.of(x)):
                if k >= len(MASKS) and len(x) >= SHORT:
                    break
                items.append(np.full(len(h), item, np.int64))
                masks.append(np.full(len(h), k, np.int32))
                hashes.append(h)
                places.append(at)
        if items:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(items)), pa.array(np.concatenate(masks)),
                    pa.array(signed(np.concatenate(hashes))), pa.array(np.concatenate(places).astype(np.int32)),
                ],
                ["item", "mask", "seed", "item_at"],
            )


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = Seeds()
    for batch in batches:
        words = [seeds.hashes(data).tobytes() for data in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, pa.binary())], ["item", "item_words"])


def _candidate_rows(filter_words, short: bool):
    """Seeds of training texts that may be benchmark seeds, and the hashed words of those texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, bits = Seeds(short), filter_words.value
        for batch in batches:
            picked, sizes, hashes, places, words = [], [], [], [], []
            for i, data in enumerate(texts_of(batch)):
                x = seeds.hashes(data)
                own = []
                for h, at in seeds.of(x):
                    found = passes(bits, h)
                    own.append((h[found], at[found]))
                n = sum(len(h) for h, _ in own)
                if n:
                    picked.append(i)
                    sizes.append(n)
                    hashes.extend(h for h, _ in own)
                    places.extend(at for _, at in own)
                    words.append(x.tobytes())
            if picked:
                found = pa.StructArray.from_arrays(
                    [pa.array(signed(np.concatenate(hashes))), pa.array(np.concatenate(places).astype(np.int32))], ["seed", "at"]
                )
                own = batch.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("doc"), own.column("th"), list_array(sizes, found), pa.array(words, pa.binary())],
                    ["id", "doc", "th", "seeds", "words"],
                )

    return rows


def best_overlap(a: np.ndarray, b: np.ndarray, shift: int, penalty: int = 2) -> tuple[int, int, int]:
    """Best run of a against b at one shift: (start in a, words, equal words).

    b[j] stands against a[j + shift]. An equal word scores 1 and a substituted one -`penalty`; the
    run with the largest sum is found in one pass over partial sums.
    """
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high <= low:
        return low, 0, 0
    same = a[low:high] == b[low - shift : high - shift]
    total = np.r_[0, np.cumsum(np.where(same, 1, -penalty))]
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    start = int(np.argmin(total[: end + 1][::-1]))
    start = end - start
    return low + start, end - start, int(same[start:end].sum())


def widest_overlap(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int, int]:
    """The run with the most equal words of which three quarters are equal, as in `best_overlap`.

    With 1 for an equal word and -3 for another such a run has a sum of 0 or more. For each end the
    first start whose partial sum is no larger is found among the least sums so far.
    """
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high <= low:
        return low, 0, 0
    same = a[low:high] == b[low - shift : high - shift]
    total = np.r_[0, np.cumsum(np.where(same, 1, -3))]
    starts = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    equal = np.r_[0, np.cumsum(same)]
    found = equal - equal[starts]
    end = int(np.argmax(found))
    start = int(starts[end])
    return low + start, end - start, int(found[end])


def best_of_shifts(a: np.ndarray, b: np.ndarray, shifts: np.ndarray, min_words: int, min_share: float) -> tuple[int, int, int] | None:
    """The accepted run with the most equal words over all shifts, then the shortest and first; None without one.

    Shifts come by the words that stand against each other, which no run exceeds. So those that cannot reach the best run are left
    out, and after a run that is equal throughout the first such shift is the answer, as in texts that repeat one word.
    """
    least = min(min_words, min_share * len(b))
    bounds = np.minimum(len(a), len(b) + shifts) - np.maximum(0, shifts)
    best = None
    for k in np.lexsort((shifts, -bounds)):
        if best is not None and (bounds[k] < best[0] or best[0] == -best[1] == bounds[k]):
            break
        for overlap in (best_overlap, widest_overlap):
            start, aligned, equal = overlap(a, b, int(shifts[k]))
            if aligned and equal >= least and equal >= 0.75 * aligned:
                best = max(best or (0, 0, 0), (equal, -aligned, -start))
                break
    return None if best is None else (-best[2], -best[1], best[0])


def _overlap_rows(min_words: int, min_share: float):
    names = ["id", "doc", "th", "item", "start", "n_aligned", "n_equal", "item_words"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, out = [], []
            for i in range(batch.num_rows):
                a = np.frombuffer(batch.column("words")[i].as_py(), np.uint64)
                b = np.frombuffer(batch.column("item_words")[i].as_py(), np.uint64)
                shifts = batch.column("shifts")[i].values.to_numpy(zero_copy_only=False)
                best = best_of_shifts(a, b, shifts.astype(np.int64), min_words, min_share)
                if best is not None:
                    picked.append(i)
                    out.append((*best, len(b)))
            own = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[own.column(c) for c in names[:4]], *[pa.array([o[k] for o in out], pa.int32()) for k in range(4)]], names
            )

    return rows


def find_contamination(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_words: int = 12,
    min_share: float = 0.8,
) -> DataFrame:
    """Documents that hold passages of benchmark items, up to substituted words: the best run for each pair.

    Words are compared in lower case without punctuation around them. Each mask of `MASKS` gives a hash at every place of
    a text that ignores the words under its zeros. Benchmark hashes fill a filter of fixed size; training
    hashes that pass it are joined with the benchmark's, so only those are shuffled. A hit fixes how
    the two texts stand against each other; the shifts of a text and an item are gathered (numbers, at most as many as
    both have words), so their words are read once, and the runs around the hits are verified: equal words score 1, substituted ones -2. A pair is reported if the run has at least
    `min_words` equal words, or `min_share` of a shorter item, and three quarters of it are equal; if the run of
    the best score has not, any other run of the shift will do, and that with the most equal words is reported.
    With the limits given here every such run holds a seed; lower limits may miss some.

    Columns: id, doc (`order_id`), th (`text_hash`), item, start, n_aligned, n_equal (words),
    item_words. Rows equal in id and text are reported once. A missing or empty text matches nothing, nor does an item with
    fewer than five words; an empty benchmark gives no rows. Ids of items are integers; rows of
    one item id with different texts are items of their own.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    items = items.distinct()
    # the number of an item stands for its id and text
    items = cut_lineage(items.withColumn("nth", F.xxhash64("item", "text")))
    numbered = items.select(F.col("nth").alias("item"), "text")
    item_seeds = cut_lineage(numbered.mapInArrow(_benchmark_rows, "item long, mask int, seed long, item_at int").distinct())
    short = not item_seeds.where(F.col("mask") >= len(MASKS)).isEmpty()
    shared = hash_filter(item_seeds, "seed")
    docs = df.select(F.col(id_col).alias("id"), order_id(id_col).alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = dict(df.dtypes)[id_col]
    found = cut_lineage(
        docs.mapInArrow(
            _candidate_rows(shared, short), f"id {kind}, doc long, th long, seeds array<struct<seed:bigint,at:int>>, words binary"
        )
    )
    hits = (
        found.select("doc", "th", F.explode("seeds").alias("s"))
        .select("doc", "th", "s.seed", "s.at")
        .join(item_seeds, "seed")
        .groupBy("doc", "th", "item")
        .agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts"))
    )
    texts = found.groupBy("doc", "th").agg(F.first("id").alias("id"), F.first("words").alias("words"))
    item_words = numbered.mapInArrow(_word_rows, "item long, item_words binary").distinct()
    runs = (
        hits.join(texts, ["doc", "th"])
        .join(item_words, "item")
        .mapInArrow(
            _overlap_rows(min_words, min_share),
            f"id {kind}, doc long, th long, item long, start int, n_aligned int, n_equal int, item_words int",
        )
    )
    return runs.join(items.select(F.col("nth").alias("item"), F.col("item").alias("item_id")), "item").select(
        F.col("id").alias(id_col), "doc", "th", "item_id", "start", "n_aligned", "n_equal", "item_words"
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The rows of `df` without those that `find_contamination` reports; columns as in `df`."""
    found = find_contamination(df, benchmark, id_col, text_col, **limits).select(F.col("doc").alias("__doc"), F.col("th").alias("__th")).distinct()
    return (
        df.withColumns({"__doc": order_id(id_col), "__th": text_hash(text_col)}).join(found, ["__doc", "__th"], "left_anti").select(*df.columns)
    )
