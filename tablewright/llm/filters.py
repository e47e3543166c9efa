"""A filter of fixed size that tasks hold: which hashes may be in a table of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bits of the filter: 8 MB, whatever the size of the table.
BITS = 26
#: Where the three bits of a hash start.
PARTS = (0, 19, 38)


def hash_filter(df: DataFrame, column: str):
    """A broadcast filter of the longs in a column. It lets all of them pass, and of others the fewer the less it holds."""
    low = F.lit(2**BITS - 1)
    words = (
        df.select(F.explode(F.array(*[F.shiftrightunsigned(column, k).bitwiseAND(low) for k in PARTS])).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    )
    filled = np.zeros(2 ** (BITS - 6), np.uint64)
    for row in words.toLocalIterator():  # at most one row for each of the filter's words
        filled[row["at"]] = row["word"] % 2**64
    return df.sparkSession.sparkContext.broadcast(filled)


def passes(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the hashes that pass."""
    low, index = np.uint64(2**BITS - 1), np.arange(len(hashes))
    for k in PARTS:
        bit = (hashes[index] >> np.uint64(k)) & low
        index = index[(filled[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
    return index


def may_hold(shared, column: str) -> Column:
    """Whether a long column's value passes a broadcast filter."""

    def look(values: pd.Series) -> pd.Series:
        out = np.zeros(len(values), bool)
        out[passes(shared.value, values.to_numpy().view(np.uint64))] = True
        return pd.Series(out)

    return F.pandas_udf(look, BooleanType())(column)
