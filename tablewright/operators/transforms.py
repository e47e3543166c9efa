"""The thirteen column transforms. Each returns a new DataFrame and leaves its input alone."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import NUMERIC, TEMPORAL, col, present, to_number
from ..session import cut_lineage
from .frequency import KEY_TYPES, columns_by_kind, key_kind, union_all
from .ordering import exact_quantiles, label_positions


class TransformError(ValueError):
    """The transform is unknown, or its columns are missing or unusable."""


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, NUMERIC):
        return present(df, name).cast("double")
    return to_number(col(name))


def _measure(df: DataFrame, columns: list[str], **aggregates) -> dict[str, dict]:
    """Run aggregates over the numeric reading of `columns`: one pass, one row back."""
    wanted = {"n": F.count, **aggregates}
    row = df.agg(
        *[f(_number(df, c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in wanted.items()]
    ).first()
    out = {c: {name: row[f"{name}{i}"] for name in wanted} for i, c in enumerate(columns)}
    for c, found in out.items():
        if found["n"] == 0:
            raise TransformError(f"Column '{c}' has no numeric values to transform.")
    return out


def log_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add `c_log`: the natural log, or log(1 + c) when the column reaches 0 or below."""
    found = _measure(df, columns, low=F.min)
    added = {}
    for c in columns:
        x = _number(df, c)
        added[f"{c}_log"] = F.log1p(x) if found[c]["low"] <= 0 else F.log(x)
    return df.withColumns(added)


def sqrt_transform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add `c_sqrt`: the square root, with negative values read as 0."""
    _measure(df, columns)
    added = {}
    for c in columns:
        x = _number(df, c)
        added[f"{c}_sqrt"] = F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))
    return df.withColumns(added)


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores in place, by the population standard deviation; columns without spread stay."""
    found = _measure(df, columns, mean=F.avg, std=F.stddev_pop)
    return df.withColumns(
        {c: (_number(df, c) - F.lit(s["mean"])) / F.lit(s["std"]) for c, s in found.items() if s["std"]}
    )


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rescale in place to 0..1; constant columns stay."""
    found = _measure(df, columns, low=F.min, high=F.max)
    return df.withColumns(
        {
            c: (_number(df, c) - F.lit(s["low"])) / F.lit(s["high"] - s["low"])
            for c, s in found.items()
            if s["high"] != s["low"]
        }
    )


def clip_bounds(
    df: DataFrame, columns: list[str], lower: float | None = None, upper: float | None = None
) -> dict[str, tuple[float, float]]:
    if lower is not None and upper is not None:
        return {c: (float(lower), float(upper)) for c in columns}
    numbers = df.select(*[_number(df, c).alias(c) for c in columns])
    found = exact_quantiles(numbers, {c: [0.01, 0.99] for c in columns})
    return {c: (v[0], v[1]) for c, v in found.items()}


def clip_outliers(
    df: DataFrame, columns: list[str], lower: float | None = None, upper: float | None = None
) -> DataFrame:
    """Clip in place to the given bounds, or to the 1st and 99th percentile."""
    _measure(df, columns)
    bounds = clip_bounds(df, columns, lower, upper)
    clipped = {}
    for c, (low, high) in bounds.items():
        x = _number(df, c)
        clipped[c] = F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)
    return df.withColumns(clipped)


def clipped_counts(
    df: DataFrame, columns: list[str], lower: float | None = None, upper: float | None = None
) -> DataFrame:
    """(column, lower_bound, upper_bound, n_clipped) of a clip."""
    bounds = clip_bounds(df, columns, lower, upper)
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(low).alias("lower_bound"), F.lit(high).alias("upper_bound"),
                F.count_if((_number(df, c) < low) | (_number(df, c) > high)).alias("n_clipped"),
            ).alias(f"f{i}")
            for i, (c, (low, high)) in enumerate(bounds.items())
        ]
    )
    return row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(bounds))])))


def bin_numeric(df: DataFrame, columns: list[str], n_bins: int = 4) -> DataFrame:
    """Add `c_binned`: quantile bins closed on the right, equal edges merged, numbered from 0."""
    _measure(df, columns)
    numbers = df.select(*[_number(df, c).alias(c) for c in columns])
    edges = exact_quantiles(numbers, {c: [i / n_bins for i in range(n_bins + 1)] for c in columns})
    added = {}
    for c in columns:
        distinct = list(dict.fromkeys(edges[c]))
        x = _number(df, c)
        place = F.lit(0)
        for edge in distinct[1:-1]:
            place = place + (x > edge).cast("int")
        # a single edge leaves no interval
        added[f"{c}_binned"] = F.when(x.isNotNull(), place) if len(distinct) > 1 else F.lit(None).cast("int")
    return df.withColumns(added)


def _labels(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """(column, label, n) of many columns by kind of label: one scan and one shuffle for each kind, written down."""
    tables = {}
    for kind, names in columns_by_kind(df, columns).items():
        keyed = df.select(*[present(df, c).cast(KEY_TYPES[kind]).alias(c) for c in names])
        tables[kind] = cut_lineage(
            keyed.unpivot([], [col(c) for c in names], "column", "label").where(F.col("label").isNotNull())
            .groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))
        )
    return tables


def one_hot_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each column by one boolean column per label, in label order; gaps are all false.

    The labels become column names, so they are read by the driver; `one_hot_vectors` takes any number of labels. A name that differs from an
    earlier one only by case gets a number, as Spark could not tell the two apart.
    """
    kept = [col(c) for c in df.columns if c not in columns]
    levels: dict[str, list] = {c: [] for c in columns}
    for kind, table in _labels(df, columns).items():
        for r in table.select("column", "label").collect():
            levels[r["column"]].append(r["label"])
    used = {c.lower() for c in df.columns if c not in columns}
    flags = []
    for c in columns:
        kind = KEY_TYPES[key_kind(df.schema[c].dataType)]
        for level in sorted(levels[c]):
            name = f"{c}_{level}"
            number = 2
            while name.lower() in used:
                name, number = f"{c}_{level}_{number}", number + 1
            used.add(name.lower())
            flags.append(F.coalesce(present(df, c).cast(kind) == F.lit(level), F.lit(False)).alias(name))
    return df.select(*kept, *flags)


def one_hot_vectors(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """One-hot encoding for any number of labels: (table, label index).

    Each column is replaced by a sparse vector `<column>_vector` with a one at its label's position; gaps have no
    one. The index (column, label as text, position from 0 in label order) stays a table in Spark: the driver sees the number
    of labels of a column and nothing else. A column without labels has vectors of size 1 without a one.
    """
    tables = [cut_lineage(label_positions(t)) for t in _labels(df, columns).values()]
    sizes = {r["column"]: r["count"] for t in tables for r in t.groupBy("column").count().collect()}  # a row for each column
    names = {c: f"__place{i}" for i, c in enumerate(columns)}
    out = df
    for table, kind_names in zip(tables, columns_by_kind(df, columns).values()):
        for c in kind_names:
            lookup = table.where(F.col("column") == c).select("label", F.col("position").cast("double").alias(names[c]))
            out = _join_lookup(out, c, lookup)
    # the encoder leaves out its last category, which stands for gaps
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(float(max(1, sizes.get(c, 0))))) for c, n in names.items()})
    largest = df.sparkSession.createDataFrame(
        [tuple(float(max(1, sizes.get(c, 0))) for c in columns)], ", ".join(f"{n} double" for n in names.values())
    )
    vectors = {c: f"__vector{i}" for i, c in enumerate(columns)}
    encoder = OneHotEncoder(inputCols=list(names.values()), outputCols=list(vectors.values()), dropLast=True)
    encoded = encoder.fit(largest).transform(out)
    kept = [col(c) for c in df.columns if c not in columns]
    index = union_all([t.select("column", F.col("label").cast("string").alias("label"), "position") for t in tables])
    return encoded.select(*kept, *[F.col(v).alias(f"{c}_vector") for c, v in vectors.items()]), index


def _join_lookup(df: DataFrame, name: str, table: DataFrame) -> DataFrame:
    """Left join a (label, ...) table on a column; Spark broadcasts the table if it is small."""
    renamed = table.withColumnRenamed("label", "__label")
    kind = KEY_TYPES[key_kind(df.schema[name].dataType)]
    return df.join(renamed, present(df, name).cast(kind) == F.col("__label"), "left").drop("__label")


def ordinal_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Labels in sorted order become 0, 1, 2..; gaps stay."""
    order = df.columns
    placed = {kind: cut_lineage(label_positions(table)) for kind, table in _labels(df, columns).items()}
    for c in columns:
        table = placed[key_kind(df.schema[c].dataType)].where(F.col("column") == c)
        df = (
            _join_lookup(df, c, table.select("label", F.col("position").alias("__position")))
            .withColumn(c, F.col("__position").cast("int")).drop("__position")
        )
    return df.select(*[col(c) for c in order])


def shares_by_column(df: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """`label_shares` of many columns, counted together."""
    shares = {}
    for kind, table in _labels(df, columns).items():
        # one row per column
        totals = table.groupBy("column").agg(F.sum("n").alias("total"))
        both = table.join(F.broadcast(totals), "column").withColumn("share", F.col("n") / F.col("total"))
        for c in columns_by_kind(df, columns)[kind]:
            shares[c] = both.where(F.col("column") == c).select("label", "n", "share")
    return shares


def label_shares(df: DataFrame, name: str) -> DataFrame:
    """(label, n, share): labels of a column and their share of the non-missing rows."""
    return shares_by_column(df, [name])[name]


def frequency_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add `c_freq`: the share of the non-missing rows that carry the label."""
    shares = shares_by_column(df, columns)
    for c in columns:
        table = shares[c].select("label", F.col("share").alias("__share"))
        df = _join_lookup(df, c, table).withColumn(f"{c}_freq", F.col("__share")).drop("__share")
    return df


def group_rare(df: DataFrame, columns: list[str], threshold_pct: float = 2.0) -> DataFrame:
    """Fold labels below a share of the non-missing rows into `Other`; a column without any stays as it is."""
    order = df.columns
    shares = shares_by_column(df, columns)
    rare = {c: shares[c].where(F.col("share") < threshold_pct / 100.0).select("label", F.lit(True).alias("__rare")) for c in columns}
    for c in columns:
        if rare[c].isEmpty():
            continue
        df = (
            _join_lookup(df, c, rare[c])
            .withColumn(c, F.when(F.col("__rare"), F.lit("Other")).otherwise(col(c).cast("string")))
            .drop("__rare")
        )
    return df.select(*[col(c) for c in order])


# Date patterns tried on text, in this order.
DATE_PATTERNS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
]


def as_moment(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, TEMPORAL):
        return col(name)
    text = col(name).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def extract_datetime_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add year, month, day of the week (Monday is 0) and a weekend flag (0 for gaps)."""
    found = df.agg(*[F.count(as_moment(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    added = {}
    for i, c in enumerate(columns):
        if found[f"n{i}"] == 0:
            raise TransformError(f"Column '{c}' could not be parsed as datetime.")
        m = as_moment(df, c)
        added[f"{c}_year"] = F.year(m)
        added[f"{c}_month"] = F.month(m)
        added[f"{c}_dayofweek"] = F.weekday(m)
        added[f"{c}_is_weekend"] = F.coalesce(F.weekday(m) >= 5, F.lit(False)).cast("int")
    return df.withColumns(added)


def drop_column(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def text_feature(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add `c_length`: characters of the text, 0 for gaps."""
    return df.withColumns({f"{c}_length": F.length(F.coalesce(present(df, c).cast("string"), F.lit(""))) for c in columns})


# transform name -> (function, evidence it reads and the argument that evidence becomes)
TRANSFORMS = {
    "log_transform": (log_transform, {}),
    "sqrt_transform": (sqrt_transform, {}),
    "standard_scale": (standard_scale, {}),
    "minmax_scale": (minmax_scale, {}),
    "clip_outliers": (clip_outliers, {"lower_bound": "lower", "upper_bound": "upper"}),
    "bin_numeric": (bin_numeric, {"n_bins": "n_bins"}),
    "one_hot_encode": (one_hot_encode, {}),
    "ordinal_encode": (ordinal_encode, {}),
    "frequency_encode": (frequency_encode, {}),
    "group_rare": (group_rare, {"threshold_pct": "threshold_pct"}),
    "extract_datetime_parts": (extract_datetime_parts, {}),
    "drop_column": (drop_column, {}),
    "text_feature": (text_feature, {}),
}


def apply_transform(df: DataFrame, transform: str, columns: list[str], evidence: dict | None = None) -> DataFrame:
    """Apply one transform by name, with the numbers of the suggestion that asked for it."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TransformError(f"Column(s) not found: {missing}")
    if transform not in TRANSFORMS:
        raise TransformError(f"Unknown transform: {transform!r}")
    function, reads = TRANSFORMS[transform]
    given = {reads[k]: v for k, v in (evidence or {}).items() if k in reads and v is not None}
    return function(df, columns, **given)
