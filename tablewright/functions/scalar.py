"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
NESTED = (T.ArrayType, T.MapType, T.StructType)

# Text longer than this is grouped by its SHA-256 digest, so that shuffles carry a fixed
# number of bytes per value however long the texts are.
KEY_LENGTH = 64


def col(name: str) -> Column:
    """A column by its exact name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pct_of(part: Column, whole: Column) -> Column:
    """100 * part / whole to two decimals, ties rounded up."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    hundredths = F.floor((part * 20000 + whole) / F.when(whole != 0, whole * 2))
    return F.when(whole == 0, F.lit(0.0)).otherwise(hundredths / F.lit(100.0))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FRACTIONAL):
        return F.when(~F.isnan(c), c)
    return c


def with_gaps(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """`df` restricted to `columns`, NaN turned into NULL."""
    names = df.columns if columns is None else columns
    return df.select(*[present(df, n).alias(n) for n in names])


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which every one of `columns` is present."""
    return df.select(*[col(c) for c in columns]).na.drop()


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target."""
    return df.where(present(df, target).isNotNull())


def normal_label(c: Column) -> Column:
    """Surrounding white space removed, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


# Blanks around a number are allowed; a letter after it, as in 12d or 1F, makes it a text.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"^\s*[+-]?(?i)inf(inity)?\s*$"


def reads_as_number(text: Column) -> Column:
    return text.rlike(NUMBER) | text.rlike(INFINITY)


def to_number(c: Column) -> Column:
    """A double, or NULL where the value does not read as a number."""
    number = F.when(reads_as_number(c.cast("string")), c.try_cast("double"))
    return F.when(~F.isnan(number), number)


def finite_or_null(c: Column) -> Column:
    """NULL for NaN and the two infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def is_whole(c: Column) -> Column:
    return c % 1 == 0


def group_key(c: Column) -> Column:
    """Text as it is when short, its digest when long."""
    return F.when(F.length(c) > KEY_LENGTH, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def contains_text(c: Column, query: str) -> Column:
    """Case-insensitive search; a missing value reads as empty text."""
    return F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lower(F.lit(query)))


def strength(score: Column) -> Column:
    return (
        F.when(score >= 0.7, "very_strong")
        .when(score >= 0.5, "strong")
        .when(score >= 0.3, "moderate")
        .otherwise("weak")
    )


def effect_label(metric: Column, value: Column) -> Column:
    """Effect-size word; the cut points depend on the metric."""
    size = F.abs(value)
    cuts = (
        F.when(metric == "pearson_r", F.array(F.lit(0.1), F.lit(0.3), F.lit(0.5)))
        .when(metric == "cohens_d", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)))
        .when(metric == "eta_squared", F.array(F.lit(0.01), F.lit(0.06), F.lit(0.14)))
        .when(metric == "cramers_v", F.array(F.lit(0.1), F.lit(0.3), F.lit(0.5)))
    )
    return (
        F.when(value.isNull() | cuts.isNull(), F.lit(None).cast("string"))
        .when(size < cuts[0], "negligible")
        .when(size < cuts[1], "small")
        .when(size < cuts[2], "medium")
        .otherwise("large")
    )
