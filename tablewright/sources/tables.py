"""Reading tables and looking at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import NUMERIC, col, contains_text, reads_as_number

# Text that stands for a missing value in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What every cell of a column must look like for the column to take a type, narrowest first.
WHOLE = r"^\s*[+-]?\d+\s*$"
TRUTH = r"^(true|false|True|False|TRUE|FALSE)$"
MOMENT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"


class EmptyTableError(ValueError):
    """The file has no rows or no columns."""


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read a CSV file with a header and inferred types.

    Everything is read as text once. Cells that are exactly a missing token are missing; blanks are
    kept. A column takes a type if all its cells read that way: whole numbers, numbers, `true` and `false`,
    or moments. Words like yes and no, and codes like 1F, stay text. One pass looks at all columns.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    if not raw.columns:
        raise EmptyTableError("CSV has no rows or no columns.")
    cleared = raw.select(*[F.when(~col(c).isin(MISSING_TOKENS), col(c)).alias(c) for c in raw.columns])

    def readings(c: str) -> dict[str, Column]:
        text = col(c)
        return {
            "bigint": F.when(text.rlike(WHOLE), F.trim(text).try_cast("bigint")),
            "double": F.when(reads_as_number(text), F.trim(text).try_cast("double")),
            "boolean": F.when(text.rlike(TRUTH), text.try_cast("boolean")),
            "timestamp": F.when(text.rlike(MOMENT), text.try_cast("timestamp")),
        }

    facts = cleared.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.struct(F.count(col(c)).alias("n"), *[F.count(r).alias(t) for t, r in readings(c).items()]).alias(f"f{i}")
            for i, c in enumerate(cleared.columns)
        ],
    ).first()
    if not facts["rows"]:
        raise EmptyTableError("CSV has no rows or no columns.")
    casts = {}
    for i, c in enumerate(cleared.columns):
        found = facts[f"f{i}"]
        kind = next((t for t in readings(c) if found["n"] and found[t] == found["n"]), None)
        # a column without any value is a column of numbers without any value
        casts[c] = readings(c)[kind] if kind else col(c).try_cast("double") if not found["n"] else col(c)
    return cleared.select(*[expression.alias(c) for c, expression in casts.items()])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, key: list[str], n: int = 10) -> DataFrame:
    """The first n rows in the order of a key; Spark keeps n rows per task, never a full sort."""
    return df.orderBy(*[col(k) for k in key]).limit(n)


def search(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose column contains the text, in any case."""
    if not query.strip():
        return df
    return df.where(contains_text(col(column), query))


def sort_by(df: DataFrame, column: str, direction: str | None = "asc") -> DataFrame:
    """Rows ordered by one column; numbers as numbers, everything else as text."""
    if direction is None:
        return df
    c = col(column)
    if not isinstance(df.schema[column].dataType, NUMERIC):
        c = c.cast("string")
    return df.orderBy(c.desc() if direction == "desc" else c.asc())
