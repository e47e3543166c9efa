"""Analyses that combine operators: the scorecard, stored runs, and derived versions."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.explanation import (
    binary_outcomes,
    confusion_cells,
    described,
    label_counts,
    permutation_importance,
    positive_class,
    refit,
    shapley_contributions,
)
from ..operators.health import health_change, health_issues, health_score
from ..operators.modelling import (
    Experiment,
    FittedModel,
    Settings,
    best_model,
    feature_selection,
    modelling_plan,
    run_experiment,
    score_summary,
)
from ..operators.patterns import findings
from ..operators.profile import Profile, column_profile, profile_of
from ..operators.significance import significance_tests
from ..operators.suggestions import feature_suggestions
from ..operators.transforms import apply_transform
from ..sources.history import ANALYSES, append_results, effective_target
from ..sources.versions import TableStore


def trust_word(score: Column) -> Column:
    return (
        F.when(score >= 85, "Trustworthy").when(score >= 70, "Mostly trustworthy").when(score >= 50, "Use with caution")
        .otherwise("Fragile")
    )


def dataset_scorecard(
    df: DataFrame, target: str | None = None, profile: Profile | None = None, experiment: Experiment | None = None,
    alpha: float = 0.05, fit_models: bool = False, settings: Settings = Settings(),
) -> DataFrame:
    """One row of verdicts: trust, grade, tests that hold up, best model.

    The profile is computed once and handed to every part. The model part comes from `experiment`, or
    from models fitted here if `fit_models` is set and there is a target.
    """
    profile = profile_of(df, profile)
    if experiment is None and fit_models and target is not None:
        experiment = run_experiment(df, target, profile, settings=settings)
    score = health_score(health_issues(df, profile)).withColumn("k", F.lit(1))
    tests = significance_tests(df, target, profile, alpha=alpha).agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("significance") == "significant").alias("n_significant"),
        F.count_if("survives").alias("n_survivors"), F.lit(1).alias("k"),
    )
    card = score.join(tests, "k").select(
        "k", F.lit(profile.n_rows).alias("n_rows"), F.lit(len(profile.rows)).alias("n_columns"),
        trust_word(F.col("score")).alias("trust"), "grade", "score", "n_issues", "n_tests", "n_significant", "n_survivors",
    )
    if experiment is not None and experiment.predictions:
        best = best_model(score_summary(experiment.scores), experiment.plan.primary_metric).select(
            F.lit(1).alias("k"), "best_model", F.col("metric").alias("model_metric"), F.col("score").alias("model_score"), "beat_baseline"
        )
        card = card.join(best, "k", "left")
    return card.drop("k")


@dataclass
class Explanation:
    """The winner of an experiment, refitted on all rows, and what it goes by."""

    experiment: Experiment
    model: str
    fitted: FittedModel
    importance: DataFrame
    contributions: DataFrame
    confusion: DataFrame | None = None
    outcomes: DataFrame | None = None


def explain_target(
    df: DataFrame, target: str, profile: Profile | None = None, experiment: Experiment | None = None,
    settings: Settings = Settings(), rows: DataFrame | None = None,
) -> Explanation:
    """From a table and a target to the reasons of its best model, in one call.

    Candidates are cross-validated, the winner is refitted on all rows, and its importances and contributions (of
    all rows, unless some are given) are laid out; for classes also the confusion of the held-out predictions.
    """
    experiment = run_experiment(df, target, profile, settings=settings) if experiment is None else experiment
    won = best_model(score_summary(experiment.scores), experiment.plan.primary_metric).first()
    if won is None or won["best_model"] is None:
        raise ValueError(f"No model could be fitted for {target!r}: {experiment.failures}")
    name = won["best_model"]
    fitted = refit(experiment, name)
    found = Explanation(
        experiment, name, fitted, permutation_importance(experiment, fitted),
        described(shapley_contributions(experiment, fitted, rows)),
    )
    if experiment.plan.problem_type != "regression":
        found.confusion = confusion_cells(experiment.predictions[name], experiment.classes)
        positive = positive_class(label_counts(experiment.frame)).first()["positive_class"]
        found.outcomes = binary_outcomes(found.confusion, positive)
    return found


def recommended_models(df: DataFrame, target: str, profile: Profile | None = None) -> DataFrame:
    """(model, rank, is_baseline, metric, n_features, excluded): the candidates for a target before anything is fitted."""
    profile = profile_of(df, profile)
    plan = modelling_plan(df, target, profile)
    rows = [(c.name, c.rank, c.baseline, plan.primary_metric, len(plan.features)) for c in plan.candidates]
    excluded = [r["column"] for r in feature_selection(profile.frame, target).where("role is null").collect()]
    table = df.sparkSession.createDataFrame(rows, "model string, rank int, is_baseline boolean, metric string, n_features int")
    return table.withColumn("excluded", F.lit(",".join(sorted(excluded))))


# What each analysis computes, as (df, target) -> DataFrame.
RUNNERS = {
    "understand": lambda df, target: column_profile(df),
    "health": lambda df, target: health_issues(df),
    "investigate": findings,
    "statistics": significance_tests,
    "feature-lab": feature_suggestions,
    "recommend": recommended_models,
    "experiment": lambda df, target: score_summary(run_experiment(df, target).complete().scores),
    "explain": lambda df, target: explain_target(df, target).importance,
    "report": dataset_scorecard,
}


def run_and_store(df: DataFrame, analysis: str, root: str, session_id: int, dataset_id: int, target: str | None = None) -> DataFrame:
    """Run one analysis, write its table under `root` and append a row to the history.

    The history row comes last, so a run that stopped half-way is never listed.
    """
    if analysis not in ANALYSES:
        raise ValueError(f"Unknown analysis {analysis!r}; known: {', '.join(sorted(ANALYSES))}.")
    if ANALYSES[analysis] == "required" and not (target or "").strip():
        raise ValueError(f"{analysis!r} needs a target.")
    spark, run_id = df.sparkSession, uuid.uuid4().hex
    path = f"{root.rstrip('/')}/results/{analysis}/{run_id}"
    started = time.perf_counter()
    RUNNERS[analysis](df, target).write.parquet(path)
    row = spark.createDataFrame(
        [(run_id, session_id, dataset_id, target, analysis, "completed", int((time.perf_counter() - started) * 1000), path)],
        "run_id string, session_id bigint, dataset_id bigint, target string, analysis string, status string, "
        "duration_ms bigint, path string",
    ).withColumn("created_at", F.current_timestamp())
    append_results(row, f"{root.rstrip('/')}/history")
    return spark.read.parquet(path)


def stored_or_run(
    df: DataFrame, analysis: str, root: str, session_id: int, dataset_id: int, target: str | None = None, refresh: bool = False
) -> DataFrame:
    """The newest stored result of an analysis of the same dataset and target; it is run only if there is none, or on `refresh`."""
    spark, path = df.sparkSession, f"{root.rstrip('/')}/history"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not refresh and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        wanted = spark.createDataFrame([(analysis, target)], "analysis string, wanted string").select(
            "analysis", effective_target(F.col("analysis"), F.col("wanted")).alias("wanted")
        )
        stored = (
            spark.read.parquet(path).where((F.col("dataset_id") == dataset_id) & (F.col("status") == "completed"))
            .join(F.broadcast(wanted), "analysis").where(F.col("target").eqNullSafe(F.col("wanted")))
            .agg(F.max_by("path", F.struct("created_at", "run_id")).alias("path")).first()
        )
        if stored["path"] is not None:
            return spark.read.parquet(stored["path"])
    return run_and_store(df, analysis, root, session_id, dataset_id, target)


def derive_version(
    store: TableStore, source: str, transform: str, columns: list[str], evidence: dict | None = None
) -> tuple[str, DataFrame]:
    """Apply one transform to a stored table, keep the result as a new version, compare health.

    Returns the new name and the one-row health comparison; the source stays as it is.
    """
    before = store.load(source)
    name = store.add_version(source, apply_transform(before, transform, columns, evidence))
    after = store.load(name)
    return name, health_change(health_issues(before), health_issues(after))
