"""Shards by jump consistent hashing, with a gapless slot for each row of a shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: no table, and a new shard takes 1/n of the keys of each old one.

    Every key jumps to ever higher shards, the next one drawn by its own random numbers, and stays
    in the last one below `shards`.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    at, target = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    while (moving := np.flatnonzero(target < shards)).size:
        at[moving] = target[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        target[moving] = ((at[moving] + 1) * (2147483648.0 / draw)).astype(np.int64)
    return at


def shard_of(key: Column, shards: int) -> Column:
    """`jump_hash` of a long column."""

    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards).astype(np.int32))

    return F.pandas_udf(jump, IntegerType())(key)


def assign_shards(
    df: DataFrame,
    shards: int,
    key_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    buckets: int = 256,
    slots: bool = True,
) -> DataFrame:
    """`df` with size, text_crc32, shard, grown_shard (with one more shard) and slot.

    The shard depends on the key columns and the number of shards alone. A missing key is a key
    like any other; rows with equal keys share a shard. A missing text has size 16 and the checksum
    of nothing. The slots of a shard are 0, 1, 2 and so on: rows are numbered within
    `buckets` parts of the shard and shifted by the rows of the parts before, so no task sorts a whole
    shard. Within a part the order is by key, checksum and size, then by a hash of the row; rows that are
    equal in all columns are interchangeable. Columns of `df` named like one of the added columns
    are replaced. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ("size", "text_crc32", "shard", "grown_shard", "slot")
    base = df.drop(*[c for c in added if c not in (*key_cols, text_col)])
    own = F.xxhash64(*[F.col(c) for c in base.columns if c != text_col])
    out = base.withColumns(
        {
            "size": (F.octet_length(text) + 16).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "__key": F.xxhash64(*[F.col(c) for c in key_cols]),
            "__row": own,
        }
    ).withColumns({"shard": shard_of(F.col("__key"), shards), "grown_shard": shard_of(F.col("__key"), shards + 1)})
    if not slots:
        return out.drop("__key", "__row")
    out = out.withColumn("__bucket", F.pmod(F.xxhash64("__row", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    # at most shards x buckets rows, whatever the input
    before = (
        out.groupBy("shard", "__bucket")
        .count()
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("count").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("shard", "__bucket", "__before")
    )
    inside = Window.partitionBy("shard", "__bucket").orderBy(*key_cols, "text_crc32", "size", "__row")
    return (
        out.withColumn("__nth", F.row_number().over(inside))
        .join(F.broadcast(before), ["shard", "__bucket"])
        .withColumn("slot", F.col("__before") + F.col("__nth") - 1)
        .drop("__key", "__row", "__bucket", "__before", "__nth")
    )


def write_shards(df: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    df.write.partitionBy("shard").parquet(path)
