"""How the table should be prepared for modelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequency import union_all
from .health import level_summary, outlier_table
from .profile import NUMERIC_TYPES, Profile, profile_of

# The order of priorities.
PRIORITY_WEIGHT = {"essential": 3, "recommended": 2, "optional": 1}

SUGGESTION = {
    "detector": "int", "column_order": "int", "transform": "string", "columns": "array<string>", "priority": "string",
    "new_column": "string", "skew": "double", "min": "double", "n_levels": "bigint", "n_affected": "bigint",
    "pct": "double", "lower_bound": "double", "upper_bound": "double", "ratio": "double",
}


def _suggest(detector: int, transform: Column | str, priority: Column | str, **values: Column) -> list[Column]:
    def as_column(x):
        return F.lit(x) if isinstance(x, str) else x

    values = {
        "detector": F.lit(detector), "transform": as_column(transform), "priority": as_column(priority),
        "columns": F.array("column"), **values,
    }
    return [(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in SUGGESTION.items()]


def drop_suggestions(profile: DataFrame) -> DataFrame:
    kind = F.col("semantic_type")
    group = F.when(kind == "identifier", 0).when(kind == "constant", 1).otherwise(2)
    return profile.where(kind.isin("identifier", "constant", "text")).select(
        *_suggest(
            0, F.when(kind == "text", "text_feature").otherwise("drop_column"),
            F.when(kind == "text", "optional").otherwise("essential"),
            column_order=group * 100_000 + F.col("position"), pct=F.when(kind == "identifier", F.col("unique_pct")),
            new_column=F.when(kind == "text", F.concat("column", F.lit("_length"))), n_levels=F.col("n_unique"),
        )
    )


def encoding_suggestions(profile: DataFrame, max_one_hot: int = 15) -> DataFrame:
    kind = F.col("semantic_type")
    few = F.col("n_unique") <= max_one_hot
    zero_one = F.forall(
        "sample_values", lambda v: (v == "") | F.lower(v).isin("0", "1", "0.0", "1.0")
    )
    categories = profile.where(kind == "categorical").select(
        *_suggest(
            1, F.when(few, "one_hot_encode").otherwise("frequency_encode"),
            F.when(few, "essential").otherwise("recommended"), column_order=F.col("position"),
            new_column=F.when(~few, F.concat("column", F.lit("_freq"))), n_levels=F.col("n_unique"),
        )
    )
    flags = profile.where((kind == "binary") & ~zero_one).select(
        *_suggest(1, "ordinal_encode", "essential", column_order=F.lit(100_000) + F.col("position"), n_levels=F.col("n_unique"))
    )
    return categories.unionByName(flags)


def skew_suggestions(profile: DataFrame) -> DataFrame:
    continuous = profile.where((F.col("semantic_type") == "numeric_continuous") & (F.abs("skew") >= 1.0) & (F.col("min") >= 0))
    strong = F.col("skew") >= 2.0
    return continuous.select(
        *_suggest(
            2, F.when(strong, "log_transform").otherwise("sqrt_transform"),
            F.when(strong, "recommended").otherwise("optional"), column_order=F.col("position"),
            new_column=F.concat("column", F.when(strong, "_log").otherwise("_sqrt")), skew=F.col("skew"), min=F.col("min"),
        )
    )


def scaling_suggestions(profile: DataFrame, min_ratio: float = 10.0) -> DataFrame:
    spread = profile.where(F.col("semantic_type").isin(*NUMERIC_TYPES) & (F.col("std") > 0))
    ratio = F.max("std") / F.min("std")
    return (
        spread.agg(
            ratio.alias("ratio"), F.count(F.lit(1)).alias("n"),
            F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda x: x["column"]).alias("columns"),
        )
        .where(F.col("n") >= 2).where(F.col("ratio") >= min_ratio)
        .select(
            *_suggest(3, "standard_scale", "recommended", columns=F.col("columns"), column_order=F.lit(0), ratio=F.round("ratio", 1))
        )
    )


def clipping_suggestions(outliers: DataFrame) -> DataFrame:
    share = F.col("n_outliers") * 100.0 / F.col("n")
    return outliers.where((F.col("n") >= 10) & (share >= 1.0)).select(
        *_suggest(
            4, "clip_outliers", "optional", column_order=F.col("column_order"), n_affected=F.col("n_outliers"),
            new_column=F.concat("column", F.lit("_clipped")), pct=F.round(share, 1),
            lower_bound=F.round("lower_bound", 2), upper_bound=F.round("upper_bound", 2),
        )
    )


def rare_label_suggestions(levels: DataFrame, profile: DataFrame) -> DataFrame:
    return levels.where("n_small >= 2").join(F.broadcast(profile.select("column", "position")), "column").select(
        *_suggest(5, "group_rare", "optional", column_order=F.col("position"), n_affected=F.col("n_small"))
    )


def date_suggestions(profile: DataFrame) -> DataFrame:
    return profile.where("semantic_type = 'datetime'").select(
        *_suggest(6, "extract_datetime_parts", "recommended", column_order=F.col("position"))
    )


def feature_suggestions(df: DataFrame, target: str | None = None, profile: Profile | None = None) -> DataFrame:
    """Every suggestion, essential ones first; none that touches only the target."""
    profile = profile_of(df, profile)
    levels = level_summary(df, profile.columns("categorical"), profile.n_rows)
    made = union_all(
        [
            drop_suggestions(profile.frame),
            encoding_suggestions(profile.frame),
            skew_suggestions(profile.frame),
            scaling_suggestions(profile.frame),
            clipping_suggestions(outlier_table(df, profile)),
            rare_label_suggestions(levels, profile.frame),
            date_suggestions(profile.frame),
        ]
    )
    if target is not None:
        made = without_target(made, target)
    return ranked_suggestions(made)


def without_target(suggestions: DataFrame, target: str) -> DataFrame:
    return suggestions.where(~((F.size("columns") == 1) & (F.col("columns")[0] == target)))


def ranked_suggestions(suggestions: DataFrame) -> DataFrame:
    weight = F.create_map(*[x for k, v in PRIORITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])[F.col("priority")]
    return suggestions.orderBy(weight.desc(), "detector", "column_order")


def suggestions_by_priority(suggestions: DataFrame) -> DataFrame:
    return suggestions.groupBy("priority").agg(F.count(F.lit(1)).alias("n_suggestions"))
