"""Value counts of many columns in one shuffle, and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import (
    FRACTIONAL,
    INTEGRAL,
    KEY_LENGTH,
    NESTED,
    TEMPORAL,
    col,
    group_key,
    present,
)
from ..session import cut_lineage

# A column is counted under a key of its own kind, so numbers and times never become text.
KEY_TYPES = {"whole": "bigint", "real": "double", "moment": "timestamp_ntz", "label": "string"}


def key_kind(data_type: T.DataType) -> str | None:
    """The kind of key a column is counted under; None for nested columns."""
    if isinstance(data_type, NESTED):
        return None
    if isinstance(data_type, INTEGRAL):
        return "whole"
    if isinstance(data_type, FRACTIONAL):
        return "real"
    if isinstance(data_type, TEMPORAL):
        return "moment"
    return "label"


def columns_by_kind(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    kinds: dict[str, list[str]] = {}
    for field in df.schema.fields:
        kind = key_kind(field.dataType)
        if kind and (columns is None or field.name in columns):
            kinds.setdefault(kind, []).append(field.name)
    return kinds


def value_counts(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(column, value, n) for columns of one kind: partial counts first, then one shuffle."""
    keyed = df.select(
        *[
            (group_key(present(df, c).cast("string")) if kind == "label" else present(df, c).cast(KEY_TYPES[kind])).alias(c)
            for c in columns
        ]
    )
    return (
        keyed.unpivot([], [col(c) for c in columns], "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def leading_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value.

    `row_number() <= k` lets Spark keep k rows per column and map task before the shuffle.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def spell_out(df: DataFrame, leading: DataFrame, columns: list[str]) -> DataFrame:
    """Put whole texts back in place of the digests in a short list of label values.

    `leading` holds a few rows per column, so it is the broadcast side. Where it holds no
    digest the join has an empty side and adaptive execution drops the second scan.
    """
    is_digest = (F.length("value") > KEY_LENGTH) & F.col("value").startswith("sha256:")
    wanted = leading.where(is_digest).select("column", "value")
    texts = (
        df.select(*[F.when(F.length(col(c).cast("string")) > KEY_LENGTH, col(c).cast("string")).alias(c) for c in columns])
        .unpivot([], [col(c) for c in columns], "column", "text")
        .where(F.col("text").isNotNull())
        .select("column", "text", group_key(F.col("text")).alias("value"))
        .join(F.broadcast(wanted), ["column", "value"])
        .groupBy("column", "value")
        .agg(F.any_value("text").alias("text"))
    )
    return leading.join(texts, ["column", "value"], "left").withColumn(
        "value", F.coalesce("text", "value")
    ).drop("text")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_unique): exact number of distinct values.

    The values are tallied through their counts, which keeps the shuffle identical to the one
    behind top values and quantiles, so that Spark runs it once for all of them.
    """
    parts = [
        value_counts(df, names, kind).groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
        for kind, names in columns_by_kind(df, columns).items()
    ]
    return union_all(parts)


# Columns per aggregate, so that the JVM can compile the generated code; each pass reads its own columns.
COLUMNS_PER_PASS = 24


def approximate_distinct_counts(df: DataFrame, columns: list[str], rsd: float = 0.02) -> DataFrame:
    """Sketch-based stand-in for `distinct_counts` on very wide tables (opt-in)."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start : start + COLUMNS_PER_PASS]
        facts = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(present(df, c), rsd).alias("n_unique")) for c in chunk]
        row = df.agg(*[f.alias(f"f{i}") for i, f in enumerate(facts)])
        parts.append(row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(chunk))]))))
    return union_all(parts)


def leading_values_of(df: DataFrame, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """(column, place, value, n): the k most frequent values of every column, as text."""
    parts = []
    for kind, names in columns_by_kind(df, columns).items():
        leading = leading_values(value_counts(df, names, kind), k)
        if kind == "label":
            leading = spell_out(df, leading, names)
        parts.append(leading.select("column", "place", F.col("value").cast("string").alias("value"), "n"))
    return union_all(parts)


def row_key(df: DataFrame) -> list[Column]:
    """One grouping key per column; equal rows have equal keys."""
    keys = []
    for field in df.schema.fields:
        c = present(df, field.name)
        if isinstance(field.dataType, NESTED):
            c = group_key(F.to_json(F.struct(c)))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            c = group_key(c if isinstance(field.dataType, T.StringType) else F.hex(c))
        keys.append(c.alias(field.name))
    return keys


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: copies after the first. Gaps compare as equal.

    A row whose hash no other row has is no copy, so hashes are counted first and whole rows are compared only where a hash
    occurs again, or everywhere if that holds for most rows.
    """
    keyed = df.select(*row_key(df))
    # equal text may differ in its bytes under a collation; the hash does without such columns
    plain = [f.name for f in keyed.schema.fields if not isinstance(f.dataType, T.StringType) or f.dataType.isUTF8BinaryCollation()]
    hashed = F.xxhash64(F.lit(0), *[col(c) for c in plain])
    tallies = keyed.groupBy(hashed.alias("__hash")).agg(F.count(F.lit(1)).alias("__n"))
    again = cut_lineage(tallies.where(F.col("__n") > 1))
    n_again = again.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    total = keyed.agg(F.count(F.lit(1)).alias("n_rows"))
    if not n_again:
        return total.select("n_rows", F.lit(0).cast("bigint").alias("n_duplicate_rows"))
    n_rows = total.first()["n_rows"]
    if 2 * n_again <= n_rows:
        keyed = keyed.withColumn("__hash", hashed).join(again.select("__hash"), "__hash", "left_semi").drop("__hash")
    groups = keyed.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return groups.agg(
        F.lit(n_rows).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).alias("n_duplicate_rows"),
    )
