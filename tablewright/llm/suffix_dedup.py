"""Suffix-array dedup: repeated byte strings by longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Settle, cut_repeats, repeated_spans


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first `length` bytes; suffixes equal in them share a rank.

    Prefix doubling: the order by 2n bytes is that of pairs of ranks by n bytes. Suffixes shorter
    than `length` have ranks without meaning.
    """

    def joined(rank: np.ndarray, by: int, bits: int) -> np.ndarray:
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - by)] = rank[by:]
        return (rank << np.uint64(bits)) | after

    rank, have = data.astype(np.uint64), 1
    while have < 8 and 2 * have <= length:  # eight bytes fit a number as they are
        rank, have = joined(rank, have, 8 * have), 2 * have
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while have < length:
        step = min(have, length - have)
        rank = np.unique(joined(rank, step, 32), return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank


def previous_and_next(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a suffix has an equal one (rank) at a smaller and at a larger position.

    In suffix order, with equal ranks in the order of their positions, the previous smaller position of a suffix
    is its neighbour; the factor shared with it has the full length if their ranks are equal.
    """
    by = np.lexsort((position, rank))
    same = rank[by][1:] == rank[by][:-1]
    before, after = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    before[by[1:]], after[by[:-1]] = same, same
    return before, after


def _repeated(window: int, keep_first: bool):
    def build() -> Settle:
        def settle(contents: list[bytes], order: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
            lengths = np.array([len(c) for c in contents])
            ends = np.cumsum(lengths)
            rank = suffix_ranks(np.frombuffer(b"".join(contents), np.uint8), window)
            whole = np.ones(len(rank), bool)  # suffixes with `window` bytes of their own block
            sizes = lengths - window + 1
            for end in ends:
                whole[end - window + 1 : end] = False
            starts = np.flatnonzero(whole)
            owner = np.repeat(np.arange(len(contents)), sizes)
            offset = starts - (ends - lengths)[owner]
            # the order of the blocks is that of their documents and places
            place = np.empty(len(contents), np.int64)
            place[np.lexsort((order["at"], order["doc"]))] = np.arange(len(contents))
            before, after = previous_and_next(rank[starts], place[owner] << 32 | offset)
            found = before if keep_first else before | after | again[owner]
            return [np.flatnonzero(p) for p in np.split(found, np.cumsum(sizes)[:-1])]

        return settle

    return build


def suffix_dedup(
    df: DataFrame,
    min_bytes: int = 400,
    seed_bytes: int | None = None,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Remove byte strings of at least `min_bytes` bytes that occur more than once.

    The longest previous factor of a position is the longest string from there that also starts
    earlier; only whether it reaches `min_bytes` matters, so suffixes are ordered by that many bytes. Suffixes that can
    match share a winnowed anchor. Blocks of suffixes that are equal as a whole are settled by
    counting; the suffixes of different blocks of an anchor are put into a suffix array in one task, where the previous
    and next smaller positions in suffix order give earlier and later matches. An anchor with very many different blocks
    is spread over tasks, and its windows meet by their hash instead.

    `keep_first`: a byte goes if a string over it has an earlier match (smaller id, or the same
    document and a smaller place), so the first copy stays; otherwise it goes if there is any other
    match. Matches don't cross documents; overlaps within one count.

    One row for each row of `df`: id, n_bytes, n_removed, n_spans, spans (in bytes), kept_bytes. A
    missing text is empty, a missing id counts as larger than any other, and rows equal in id and text
    count as two places only where `keep_first` is off. Other columns are not read.
    """
    seed_bytes = seed_bytes or max(1, min_bytes // 2)
    spans = repeated_spans(
        df, "bytes", min_bytes, seed_bytes, _repeated(min_bytes, keep_first), earlier_only=keep_first, by_document=False,
        id_col=id_col, text_col=text_col,
    )
    return (
        cut_repeats(df, spans, "bytes", id_col, text_col)
        .withColumnRenamed("n_units", "n_bytes")
        .withColumn("kept_bytes", F.col("kept"))
        .drop("kept")
    )
