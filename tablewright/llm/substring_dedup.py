"""Substring dedup by seed and extend."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BLOCK_BASE, Settle, cut_repeats, repeated_spans
from .tokens import Rolling, WordHashes


def _first_documents(window: int):
    """Of the windows of some blocks, those that a document with a smaller id has too."""

    def build() -> Settle:
        hashes, rolling = WordHashes(), Rolling(BLOCK_BASE)

        def settle(contents: list[bytes], order: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
            windows = [rolling.windows(hashes.of(c.split()), window) for c in contents]
            sizes = [len(w) for w in windows]
            value, doc = np.concatenate(windows), np.repeat(order["doc"], sizes)
            by = np.lexsort((doc, value))
            start = np.r_[True, value[by][1:] != value[by][:-1]]
            low = doc[by][np.flatnonzero(start)][np.cumsum(start) - 1]
            late = np.zeros(len(value), bool)
            late[by] = doc[by] > low
            return [np.flatnonzero(p) for p in np.split(late, np.cumsum(sizes)[:-1])]

        return settle

    return build


def substring_dedup(
    df: DataFrame, min_words: int = 50, seed_words: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Remove repeats of at least `min_words` words, keeping them in the document with the smallest id.

    Seeds are winnowed grams of `seed_words` words: a repeat of `min_words` words holds a seed that all
    its copies select. Documents are joined on seeds, a seed is extended both ways to the words of all
    windows of `min_words` that select it, and what matches is joined to maximal repeats (`spans`, in
    words; spans that touch are one). A word goes if a window over it also starts in a document with a smaller id.

    One row for each row of `df`: id, n_words, n_removed, n_spans, spans, kept_text (kept words joined
    by one space). A missing or empty text has no words; a missing id counts as larger than any other; rows with
    the same id don't remove anything from each other. Texts with fewer words than `min_words` stay
    whole. Words are compared by 64-bit hashes of the seed and of the window. Other columns are not read.
    """
    seed_words = seed_words or max(1, min_words * 2 // 5)
    spans = repeated_spans(
        df, "words", min_words, seed_words, _first_documents(min_words), earlier_only=True, by_document=True, id_col=id_col, text_col=text_col
    )
    return (
        cut_repeats(df, spans, "words", id_col, text_col)
        .withColumnRenamed("n_units", "n_words")
        .withColumn("kept_text", F.col("kept").cast("string"))
        .drop("kept")
    )
