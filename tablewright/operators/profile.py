"""What each column is: counts, semantic type and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import (
    FRACTIONAL,
    INTEGRAL,
    NESTED,
    NUMERIC,
    TEMPORAL,
    col,
    is_whole,
    pct_of,
    present,
)
from .frequency import (
    approximate_distinct_counts,
    distinct_counts,
    duplicate_rows,
    leading_values_of,
    union_all,
)
from .ordering import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]
NUMERIC_TYPES = ("numeric_continuous", "numeric_discrete")
GROUP_TYPES = ("categorical", "binary")
# Wide aggregates are split so that the JVM can compile the generated code. Each part reads
# only its own columns, so the split adds no input.
COLUMNS_PER_PASS = 6

FACTS = (
    "struct<position:int,column:string,storage_type:string,numeric:boolean,n_total:bigint,n_present:bigint,"
    "min:double,max:double,mean:double,std:double,skew:double,whole:boolean,avg_length:double,"
    "space_share:double,earliest:string,latest:string>"
)


def sample_skew(c: Column) -> Column:
    """Skewness adjusted for the sample size; 0 for fewer than three values or no spread."""
    n = F.count(c)
    return F.when(
        n > 2, F.coalesce(F.skewness(c), F.lit(0.0)) * F.sqrt(n.cast("double") * (n - 1)) / F.nullif(n - 2, F.lit(0))
    ).otherwise(F.lit(0.0))


def _facts_of(df: DataFrame, position: int, field: T.StructField) -> Column:
    c = present(df, field.name)
    kind = field.dataType
    null = F.lit(None)
    number = c.cast("double") if isinstance(kind, NUMERIC) else None
    text = c if isinstance(kind, T.StringType) else None
    moment = c.cast("timestamp_ntz") if isinstance(kind, TEMPORAL) else None
    if isinstance(kind, INTEGRAL):
        whole = F.lit(True)
    elif isinstance(kind, FRACTIONAL + (T.DecimalType,)):
        whole = F.coalesce(F.bool_and(is_whole(c)), F.lit(True))
    else:
        whole = F.lit(False)
    has_number = number is not None
    return F.struct(
        F.lit(position),
        F.lit(field.name),
        F.lit(kind.simpleString()),
        F.lit(has_number),
        F.count(F.lit(1)),
        F.count(c),
        F.min(number) if has_number else null,
        F.max(number) if has_number else null,
        F.avg(number) if has_number else null,
        F.stddev_samp(number) if has_number else null,
        sample_skew(number) if has_number else null,
        whole,
        F.avg(F.length(text)) if text is not None else null,
        F.avg((F.instr(text, " ") > 0).cast("int")) if text is not None else null,
        F.min(moment).cast("string") if moment is not None else null,
        F.max(moment).cast("string") if moment is not None else null,
    ).cast(FACTS)


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column from one pass: counts, moments, text shape, time range."""
    fields = list(enumerate(df.schema.fields))
    parts = []
    for start in range(0, len(fields), COLUMNS_PER_PASS):
        chunk = fields[start : start + COLUMNS_PER_PASS]
        row = df.agg(*[_facts_of(df, i, f).alias(f"f{i}") for i, f in chunk])
        parts.append(row.select(F.inline(F.array(*[F.col(f"f{i}") for i, _ in chunk]))))
    return union_all(parts)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns stored as numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def quantile_table(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(column, quantiles): exact and interpolated, as an array in the order asked for."""
    found = exact_quantiles(df, {c: probabilities for c in columns}) if columns else {}
    return df.sparkSession.createDataFrame([(c, v) for c, v in found.items()], "column string, quantiles array<double>")


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """min, max, mean, median, std, quartiles and skew of numeric columns."""
    columns = columns or numeric_columns(df)
    narrow = df.select(*[col(c) for c in columns])
    facts = column_facts(narrow)
    quartiles = quantile_table(narrow, columns, QUARTILES)
    return facts.join(F.broadcast(quartiles), "column", "left").select(
        "column",
        F.col("n_present").alias("n"),
        "min",
        "max",
        F.round("mean", 4).alias("mean"),
        F.round(F.col("quantiles")[1], 4).alias("median"),
        F.round(F.coalesce("std", F.lit(0.0)), 4).alias("std"),
        F.round(F.col("quantiles")[0], 4).alias("q25"),
        F.round(F.col("quantiles")[2], 4).alias("q75"),
        F.round("skew", 4).alias("skew"),
        "whole",
    )


def semantic_type(nested: Column) -> Column:
    """The type ladder, first match wins; reads the columns of the assembled profile."""
    n_unique, n_present = F.col("n_unique"), F.col("n_present")
    share = n_unique / F.when(n_present > 0, n_present)
    code_like = ~(F.coalesce("space_share", F.lit(0.0)) > 0.5) & (F.col("avg_length") <= 20)
    is_text = F.col("storage_type").startswith("string") | F.col("storage_type").rlike("^(var)?char")
    return (
        F.when(nested, "unknown")
        .when(n_unique <= 1, "constant")
        .when(F.col("earliest").isNotNull(), "datetime")
        .when(n_unique == 2, "binary")
        .when(F.col("numeric") & F.col("whole") & (share >= 0.98), "identifier")
        .when(F.col("numeric") & F.col("whole") & (n_unique <= 20), "numeric_discrete")
        .when(F.col("numeric"), "numeric_continuous")
        .when(is_text & (share >= 0.9) & code_like, "identifier")
        .when(is_text & (share >= 0.9), "text")
        .when(is_text, "categorical")
        .when(F.col("storage_type") == "boolean", "binary")
        .otherwise("unknown")
    )


def column_profile(df: DataFrame, distinct: str = "exact") -> DataFrame:
    """One row per column: counts, semantic type, statistics, top values and examples.

    One pass gives counts and moments, one shuffle per kind of key gives distinct counts and top
    values, and quartiles are narrowed down scan by scan. `distinct="approx"` swaps the exact distinct counts for sketches.
    """
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)]
    facts = column_facts(df)
    empty_counts = df.sparkSession.createDataFrame([], "column string, n_unique bigint")
    if not plain:
        uniques = empty_counts
    elif distinct == "approx":
        uniques = approximate_distinct_counts(df, plain)
    else:
        uniques = distinct_counts(df, plain)
    quartiles = quantile_table(df, numeric_columns(df), QUARTILES)
    if plain:
        top = leading_values_of(df, 10, plain).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("leaders")
        )
    else:
        top = df.sparkSession.createDataFrame(
            [], "column string, leaders array<struct<place:int,value:string,n:bigint>>"
        )
    # every side below holds one row per column of the table
    joined = (
        facts.join(F.broadcast(uniques), "column", "left")
        .join(F.broadcast(quartiles), "column", "left")
        .join(F.broadcast(top), "column", "left")
    )
    nested = F.col("storage_type").rlike("^(array|map|struct)<")
    joined = joined.withColumn(
        "n_unique", F.when(~nested, F.coalesce("n_unique", F.lit(0)))
    ).withColumn("semantic_type", semantic_type(nested))
    kind = F.col("semantic_type")
    measured = F.col("numeric") & kind.isin("identifier", *NUMERIC_TYPES)
    label_like = kind.isin(*GROUP_TYPES)

    def stat(c: Column) -> Column:
        return F.when(measured, c)

    q = F.col("quantiles")
    return joined.select(
        "position",
        "column",
        "storage_type",
        "semantic_type",
        "n_total",
        (F.col("n_total") - F.col("n_present")).alias("n_missing"),
        pct_of(F.col("n_total") - F.col("n_present"), F.col("n_total")).alias("missing_pct"),
        "n_unique",
        pct_of(F.col("n_unique"), F.col("n_present")).alias("unique_pct"),
        stat(F.col("min")).alias("min"),
        stat(F.col("max")).alias("max"),
        stat(F.round("mean", 4)).alias("mean"),
        stat(F.round(q[1], 4)).alias("median"),
        stat(F.round(F.coalesce("std", F.lit(0.0)), 4)).alias("std"),
        stat(F.round(q[0], 4)).alias("q25"),
        stat(F.round(q[2], 4)).alias("q75"),
        stat(F.round("skew", 4)).alias("skew"),
        stat(q[0]).alias("q25_exact"),
        stat(q[2]).alias("q75_exact"),
        F.when(~F.col("numeric") & kind.isin("identifier", "text"), F.round("avg_length", 1)).alias("avg_char_length"),
        F.when(kind == "datetime", F.col("earliest")).alias("earliest"),
        F.when(kind == "datetime", F.col("latest")).alias("latest"),
        F.when(label_like, F.transform("leaders", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))).alias(
            "top_values"
        ),
        F.transform(F.slice("leaders", 1, 5), lambda x: x["value"]).alias("sample_values"),
    )


class Profile:
    """A computed column profile: a few rows, one per column, shared by later analyses."""

    def __init__(self, frame: DataFrame, rows: list[Row]):
        self.frame = frame
        self.rows = sorted(rows, key=lambda r: r["position"])
        self.n_rows = self.rows[0]["n_total"] if self.rows else 0

    @classmethod
    def of(cls, df: DataFrame, **options) -> Profile:
        """Run `column_profile` once and keep its rows (one per column) for planning."""
        lazy = column_profile(df, **options)
        rows = lazy.collect()
        return cls(df.sparkSession.createDataFrame(rows, lazy.schema).coalesce(1), rows)

    def named(self, column: str) -> Row | None:
        return next((r for r in self.rows if r["column"] == column), None)

    def columns(self, *semantic_types: str) -> list[str]:
        return [r["column"] for r in self.rows if r["semantic_type"] in semantic_types]


def profile_of(df: DataFrame, profile: Profile | None = None) -> Profile:
    return profile if profile is not None else Profile.of(df)


def columns_of_type(profile: DataFrame, *semantic_types: str) -> DataFrame:
    """The profile rows of the given semantic types."""
    return profile.where(F.col("semantic_type").isin(*semantic_types))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: shape and duplicates."""
    return duplicate_rows(df).select("n_rows", F.lit(len(df.columns)).alias("n_cols"), "n_duplicate_rows")


def column_makeup(profile: DataFrame) -> DataFrame:
    """Number of columns of each semantic type."""
    return profile.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n_columns"))


def observations(profile: DataFrame) -> DataFrame:
    """One row: lists of identifier, constant and binary columns, and the worst gap."""

    def names(kind: str) -> Column:
        found = F.collect_list(F.when(F.col("semantic_type") == kind, F.struct("position", "column")))
        return F.array_join(F.transform(F.array_sort(found), lambda x: x["column"]), ",")

    gap = F.col("missing_pct") > 0
    # ties go to the first column
    order = F.struct(F.col("missing_pct"), -F.col("position"))
    return profile.agg(
        names("identifier").alias("identifiers"),
        names("constant").alias("constants"),
        names("binary").alias("binaries"),
        F.count_if(gap).alias("n_columns_with_gaps"),
        F.max_by(F.when(gap, F.col("column")), F.when(gap, order)).alias("worst_gap_column"),
        F.max(F.when(gap, F.col("missing_pct"))).alias("worst_gap_pct"),
    )


def top_values(profile: DataFrame) -> DataFrame:
    """(column, place, value, n) of label-like columns."""
    return profile.select("column", F.posexplode("top_values").alias("place", "leader")).select(
        "column", (F.col("place") + 1).alias("place"), F.col("leader.value").alias("value"), F.col("leader.n").alias("n")
    )
