"""Sessions and stored results of analyses, as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The analyses, and whether they ignore, may use or need a target.
ANALYSES = {
    "understand": "independent",
    "health": "independent",
    "investigate": "optional",
    "statistics": "optional",
    "feature-lab": "optional",
    "recommend": "required",
    "experiment": "required",
    "explain": "required",
    "report": "optional",
}


def clean_target(target: Column) -> Column:
    """Blank targets are no target."""
    trimmed = F.regexp_replace(target, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def effective_target(analysis: Column, target: Column) -> Column:
    """The target an analysis is stored under: none for those that ignore it."""
    independent = [k for k, mode in ANALYSES.items() if mode == "independent"]
    return F.when(~analysis.isin(independent), clean_target(target))


def append_results(results: DataFrame, path: str) -> None:
    """Append (run_id, session_id, dataset, target, analysis, status, created_at, duration_ms) rows.

    A rerun is a new run; nothing stored is changed.
    """
    results.withColumn("target", effective_target(F.col("analysis"), F.col("target"))).write.mode("append").partitionBy(
        "analysis"
    ).parquet(path)


def latest_results(results: DataFrame) -> DataFrame:
    """One row per (session, analysis): the newest run."""
    newest = F.struct("created_at", "run_id")
    others = [c for c in results.columns if c not in ("session_id", "analysis")]
    return (
        results.groupBy("session_id", "analysis")
        .agg(F.max_by(F.struct(*others), newest).alias("last"))
        .select("session_id", "analysis", "last.*")
    )


def active_sessions(sessions: DataFrame) -> DataFrame:
    """The newest session of every (dataset, target); ties go to the larger id.

    An aggregate rather than a window, so a dataset with most of the sessions is reduced
    before the shuffle.
    """
    newest = F.max(F.struct("created_at", "session_id"))
    return (
        sessions.groupBy("dataset_id", clean_target(F.col("target")).alias("target"))
        .agg(newest.alias("last"))
        .select("dataset_id", "target", F.col("last.session_id").alias("session_id"), F.col("last.created_at").alias("created_at"))
    )


def session_history(
    sessions: DataFrame, dataset_id: int, target: str | None = None, include_base: bool = True
) -> DataFrame:
    """Sessions of a dataset, newest first; with a target, that target and optionally the base."""
    own = sessions.withColumn("target", clean_target(F.col("target"))).where(F.col("dataset_id") == dataset_id)
    wanted = (target or "").strip()
    if wanted:
        keep = F.col("target") == wanted
        own = own.where(keep | F.col("target").isNull() if include_base else keep)
    return own.orderBy(F.desc("created_at"), F.desc("session_id"))


def completed_analyses(results: DataFrame) -> DataFrame:
    """(session_id, analyses): finished analyses in the order they were first stored.

    Each analysis counts once, so a list holds at most as many entries as there are analyses.
    """
    first = (
        results.where("status = 'completed'").groupBy("session_id", "analysis").agg(F.min("created_at").alias("created_at"))
    )
    return first.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("created_at", "analysis"))), lambda x: x["analysis"]).alias("analyses")
    )


def analyses_to_run(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests (dataset_id, target, analysis, refresh) whose result is missing or must be renewed."""
    asked = requests.withColumn("target", effective_target(F.col("analysis"), F.col("target")))
    done = (
        results.where("status = 'completed'")
        .select(
            F.col("dataset_id").alias("d"), effective_target(F.col("analysis"), F.col("target")).alias("t"),
            F.col("analysis").alias("a"),
        )
        .distinct()
    )
    same = (F.col("dataset_id") == F.col("d")) & (F.col("analysis") == F.col("a")) & F.col("target").eqNullSafe(F.col("t"))
    missing = asked.where(~F.coalesce("refresh", F.lit(False))).join(done, same, "left_anti")
    return missing.unionByName(asked.where(F.coalesce("refresh", F.lit(False))))
