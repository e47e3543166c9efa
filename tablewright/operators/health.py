"""Can the table be trusted: issues, score, grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import KEY_LENGTH, col, group_key, normal_label, pct_of, present
from ..session import cut_lineage
from .frequency import duplicate_rows, leading_values, spell_out, union_all, value_counts
from .profile import Profile, profile_of

# Penalty per issue, and the order in which severities are shown.
SEVERITY_WEIGHT = {"info": 0.0, "low": 2.0, "medium": 6.0, "high": 12.0, "critical": 25.0}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
# The quality dimension each category counts against.
DIMENSION = {
    "missing_values": "completeness",
    "inconsistent_values": "consistency",
    "rare_category": "consistency",
    "constant_column": "validity",
    "class_imbalance": "validity",
    "duplicate_rows": "uniqueness",
    "high_cardinality": "uniqueness",
    "outliers": "distribution",
}
DIMENSIONS = ["completeness", "consistency", "validity", "uniqueness", "distribution"]

COLUMNS_PER_PASS = 20


def _lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[c]


def _issue(check: int, category: str, severity: Column, **evidence: Column) -> list[Column]:
    """The columns every issue has; evidence a check does not use stays NULL."""
    types = {
        "column_order": "int", "column": "string", "n_affected": "bigint", "pct": "double", "n_levels": "bigint",
        "lower_bound": "double", "upper_bound": "double", "examples": "array<string>", "advice": "string",
    }
    return [
        F.lit(check).alias("check_order"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        *[(evidence[k] if k in evidence else F.lit(None)).cast(t).alias(k) for k, t in types.items()],
    ]


def missing_issues(profile: DataFrame) -> DataFrame:
    pct, kind = F.col("missing_pct"), F.col("semantic_type")
    severity = F.when(pct >= 60, "critical").when(pct >= 30, "high").when(pct >= 5, "medium").otherwise("low")
    advice = (
        F.when(pct >= 60, "drop_column")
        .when((kind == "numeric_continuous") & (F.abs("skew") > 1), "fill_median")
        .when(kind == "numeric_continuous", "fill_mean_or_median")
        .when(kind.isin("categorical", "binary", "numeric_discrete"), "fill_mode")
        .otherwise("review")
    )
    return profile.where("n_missing > 0").select(
        *_issue(
            0, "missing_values", severity, column_order=F.col("position"), column=F.col("column"),
            n_affected=F.col("n_missing"), pct=pct, advice=advice,
        )
    )


def duplicate_issues(duplicates: DataFrame) -> DataFrame:
    """`duplicates` is the one-row result of `duplicate_rows`."""
    pct = pct_of(F.col("n_duplicate_rows"), F.col("n_rows"))
    return duplicates.where("n_duplicate_rows > 0").select(
        *_issue(
            1, "duplicate_rows", F.when(pct >= 10, "high").otherwise("medium"), column_order=F.lit(-1),
            n_affected=F.col("n_duplicate_rows"), pct=pct, advice=F.lit("review_duplicates"),
        )
    )


def constant_issues(profile: DataFrame) -> DataFrame:
    return profile.where("semantic_type = 'constant'").select(
        *_issue(
            2, "constant_column", F.lit("medium"), column_order=F.col("position"), column=F.col("column"),
            n_levels=F.col("n_unique"), examples=F.slice("sample_values", 1, 3), advice=F.lit("drop_column"),
        )
    )


def outlier_table(df: DataFrame, profile: Profile) -> DataFrame:
    """Quartile fences of continuous columns and how many values lie outside them.

    The fences come from the profile, so all columns are counted in one pass of plain
    comparisons.
    """
    schema = (
        "struct<column_order:int,column:string,n:bigint,lower_bound:double,upper_bound:double,"
        "n_outliers:bigint,min:double,max:double>"
    )
    rows = [r for r in profile.rows if r["semantic_type"] == "numeric_continuous"]
    rows = [r for r in rows if r["q75_exact"] is not None and r["q75_exact"] - r["q25_exact"] > 0]
    if not rows:
        return df.sparkSession.createDataFrame([], schema[len("struct<") : -1].replace(":", " "))
    parts = []
    for start in range(0, len(rows), COLUMNS_PER_PASS):
        chunk = rows[start : start + COLUMNS_PER_PASS]
        facts = []
        for r in chunk:
            spread = r["q75_exact"] - r["q25_exact"]
            low, high = r["q25_exact"] - 1.5 * spread, r["q75_exact"] + 1.5 * spread
            c = present(df, r["column"]).cast("double")
            facts.append(
                F.struct(
                    F.lit(r["position"]), F.lit(r["column"]), F.count(c), F.lit(low), F.lit(high),
                    F.count_if((c < low) | (c > high)), F.min(c), F.max(c),
                ).cast(schema).alias(f"f{len(facts)}")
            )
        row = df.agg(*facts)
        parts.append(row.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(facts))]))))
    return union_all(parts)


def outlier_issues(outliers: DataFrame) -> DataFrame:
    pct = pct_of(F.col("n_outliers"), F.col("n"))
    return outliers.where("n >= 4 AND n_outliers > 0").select(
        *_issue(
            3, "outliers", F.when(pct >= 5, "medium").otherwise("low"), column_order=F.col("column_order"),
            column=F.col("column"), n_affected=F.col("n_outliers"), pct=pct,
            lower_bound=F.round("lower_bound", 4), upper_bound=F.round("upper_bound", 4), advice=F.lit("inspect_extremes"),
        )
    )


def cardinality_issues(profile: DataFrame, min_levels: int = 50) -> DataFrame:
    return profile.where((F.col("semantic_type") == "categorical") & (F.col("n_unique") >= min_levels)).select(
        *_issue(
            4, "high_cardinality", F.lit("medium"), column_order=F.col("position"), column=F.col("column"),
            n_levels=F.col("n_unique"), pct=F.col("unique_pct"), advice=F.lit("group_or_frequency_encode"),
        )
    )


LEVELS_SCHEMA = "column string, raw_levels bigint, normal_levels bigint, n_rare bigint, n_small bigint"


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, raw, clean, n): rows of each label, written once, with the cleaned label beside it.

    One scan and one shuffle count the labels. A label is cleaned after it was counted, once and not in every row; only
    labels longer than the grouping key are cleaned before, as they are shortened.
    """
    text = df.select(*[present(df, c).cast("string").alias(c) for c in columns])
    cells = [
        F.struct(
            F.lit(c).alias("column"), group_key(col(c)).alias("raw"),
            F.when(F.length(col(c)) > KEY_LENGTH, group_key(normal_label(col(c)))).alias("clean"),
        )
        for c in columns
    ]
    counts = (
        text.select(F.inline(F.array(*cells))).where(F.col("raw").isNotNull())
        .groupBy("column", "raw", "clean").agg(F.count(F.lit(1)).alias("n"))
    )
    return cut_lineage(counts.withColumn("clean", F.coalesce("clean", group_key(normal_label(F.col("raw"))))))


def level_summary(
    df: DataFrame, columns: list[str], n_rows: int, max_rare: int = 2, min_share: float = 0.02, counts: DataFrame | None = None
) -> DataFrame:
    """Per categorical column: levels, levels after clean-up, rare levels, levels under a share of all rows.

    `counts` are the `label_counts` of these columns, if they are known; both sides of the result read them.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], LEVELS_SCHEMA)
    counts = label_counts(df, columns) if counts is None else counts
    per_column = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("raw_levels"),
        F.count_if(F.col("n") <= max_rare).alias("n_rare"),
        F.count_if(F.col("n") / F.lit(n_rows) < min_share).alias("n_small"),
    )
    cleaned = counts.select("column", "clean").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("normal_levels"))
    return per_column.join(F.broadcast(cleaned), "column").select("column", "raw_levels", "normal_levels", "n_rare", "n_small")


def rare_examples(df: DataFrame, columns: list[str], max_rare: int = 2, k: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """(column, examples): up to k rare levels per column, most frequent first. `counts`: their `label_counts`, if known."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, examples array<string>")
    counted = value_counts(df, columns, "label") if counts is None else counts.select("column", F.col("raw").alias("value"), "n")
    rare = counted.where(F.col("n") <= max_rare)
    named = spell_out(df, leading_values(rare, k), columns)
    return named.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("examples")
    )


def rare_issues(levels: DataFrame, examples: DataFrame, profile: DataFrame) -> DataFrame:
    order = profile.select("column", F.col("position"))
    return (
        levels.where("n_rare > 0").join(F.broadcast(order), "column").join(F.broadcast(examples), "column", "left")
        .select(
            *_issue(
                5, "rare_category", F.lit("low"), column_order=F.col("position"), column=F.col("column"),
                n_levels=F.col("n_rare"), examples=F.col("examples"), advice=F.lit("group_rare"),
            )
        )
    )


def minority_share(profile: DataFrame) -> DataFrame:
    """Binary columns with the percentage of their rarer value."""
    counts = F.transform("top_values", lambda x: x["n"])
    return profile.where("semantic_type = 'binary'").select(
        "position", "column",
        pct_of(F.array_min(counts), F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("minority_pct"),
        F.array_min(counts).alias("minority_n"),
    )


def imbalance_issues(profile: DataFrame) -> DataFrame:
    pct = F.col("minority_pct")
    return minority_share(profile).where(pct < 25).select(
        *_issue(
            6, "class_imbalance", F.when(pct < 10, "high").otherwise("medium"), column_order=F.col("position"),
            column=F.col("column"), n_affected=F.col("minority_n"), pct=pct, advice=F.lit("use_f1_or_resample"),
        )
    )


def inconsistency_issues(levels: DataFrame, profile: DataFrame) -> DataFrame:
    order = profile.select("column", "position")
    return levels.where("normal_levels < raw_levels").join(F.broadcast(order), "column").select(
        *_issue(
            7, "inconsistent_values", F.lit("medium"), column_order=F.col("position"), column=F.col("column"),
            n_affected=F.col("raw_levels") - F.col("normal_levels"), n_levels=F.col("raw_levels"),
            advice=F.lit("standardise_labels"),
        )
    )


def health_issues(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Every issue of the table, most severe first."""
    profile = profile_of(df, profile)
    categories = profile.columns("categorical")
    counts = label_counts(df, categories) if categories else None
    levels = level_summary(df, categories, profile.n_rows, counts=counts)
    found = union_all(
        [
            missing_issues(profile.frame),
            duplicate_issues(duplicate_rows(df)),
            constant_issues(profile.frame),
            outlier_issues(outlier_table(df, profile)),
            cardinality_issues(profile.frame),
            rare_issues(levels, rare_examples(df, categories, counts=counts), profile.frame),
            imbalance_issues(profile.frame),
            inconsistency_issues(levels, profile.frame),
        ]
    )
    return ranked_issues(found)


def ranked_issues(issues: DataFrame) -> DataFrame:
    """Most severe first; then in the order of the checks and of the columns."""
    return issues.withColumn("severity_rank", _lookup(F.col("severity"), SEVERITY_RANK)).orderBy(
        "severity_rank", "check_order", "column_order"
    )


def health_score(issues: DataFrame) -> DataFrame:
    """One row: score from 0 to 100, its grade, and the number of issues."""
    lost = F.coalesce(F.sum(_lookup(F.col("severity"), SEVERITY_WEIGHT)), F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.round(F.lit(100.0) - lost, 1))
    return issues.agg(score.alias("score"), F.count(F.lit(1)).alias("n_issues")).select(
        "score", grade(F.col("score")).alias("grade"), "n_issues"
    )


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def issues_by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n_issues"))


def most_urgent_issue(issues: DataFrame) -> DataFrame:
    return ranked_issues(issues).limit(1)


def quality_dimensions(issues: DataFrame) -> DataFrame:
    """Five scores; each issue costs one and a half times its weight in its dimension."""
    weight = _lookup(F.col("severity"), {**SEVERITY_WEIGHT, "info": 2.0})
    lost = issues.groupBy(_lookup(F.col("category"), DIMENSION).alias("dimension")).agg(F.sum(weight * 1.5).alias("lost"))
    names = issues.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    left = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce("lost", F.lit(0.0)))
    return names.join(F.broadcast(lost), "dimension", "left").select(
        "dimension", F.floor(left + 0.5).cast("bigint").alias("score")
    )


def filter_issues(
    issues: DataFrame, severity: str | None = None, column: str | None = None, category: str | None = None
) -> DataFrame:
    for name, wanted in (("severity", severity), ("column", column), ("category", category)):
        if wanted is not None:
            issues = issues.where(F.col(name) == wanted)
    return issues


def health_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: score and grade of two issue tables and the difference."""
    b = health_score(before).select(F.lit(1).alias("k"), F.col("score").alias("score_before"), F.col("grade").alias("grade_before"))
    a = health_score(after).select(F.lit(1).alias("k"), F.col("score").alias("score_after"), F.col("grade").alias("grade_after"))
    return b.join(a, "k").drop("k").withColumn("delta", F.round(F.col("score_after") - F.col("score_before"), 1))
