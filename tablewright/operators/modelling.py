"""Which baseline model predicts a target best: plan, folds, training, scores."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalar import col, present
from ..session import cut_lineage, spread
from .frequency import leading_values, spell_out, union_all, value_counts
from .least_squares import MOST_PLACES, Moments, joined, moments_by, plane_points
from .ordering import exact_quantiles, positions_within, running_total, running_totals
from .profile import GROUP_TYPES, NUMERIC_TYPES, Profile, profile_of

LOWER_IS_BETTER = ("rmse", "mae")


# ---- plan -----------------------------------------------------------------------------------


def problem_types(profile: DataFrame) -> DataFrame:
    """(column, problem_type): the problem each column would pose as a target."""
    kind = F.col("semantic_type")
    return profile.select(
        "position",
        "column",
        F.when(kind == "binary", "binary_classification")
        .when(kind == "numeric_continuous", "regression")
        .when(kind == "categorical", "multiclass_classification")
        .when((kind == "numeric_discrete") & (F.col("n_unique") <= 15), "multiclass_classification")
        .when(kind == "numeric_discrete", "regression")
        .otherwise("unknown")
        .alias("problem_type"),
    )


def feature_selection(profile: DataFrame, target: str) -> DataFrame:
    """(column, used, reason, role): what becomes a model input and why the rest does not.

    Dates are usable by type but have no role in the pipeline, which takes numbers and labels.
    """
    kind = F.col("semantic_type")
    reason = (
        F.when(kind.isin("identifier", "constant", "text", "unknown"), kind)
        .when(F.col("missing_pct") > 60.0, "mostly_missing")
    )
    role = F.when(kind.isin(*NUMERIC_TYPES), "numeric").when(kind.isin(*GROUP_TYPES), "categorical")
    return profile.where(F.col("column") != target).select(
        "position", "column", reason.isNull().alias("used"), reason.alias("reason"), F.when(reason.isNull(), role).alias("role")
    )


def target_balance(profile: DataFrame, target: str) -> DataFrame:
    """(top_share, primary_metric, severe): gaps count in the denominator."""
    share = F.array_max(F.transform("top_values", lambda x: x["n"])) / F.when(F.col("n_total") > 0, F.col("n_total"))
    return profile.where(F.col("column") == target).select(
        "column", share.alias("top_share"),
        F.when(share >= 0.7, "f1").otherwise("accuracy").alias("primary_metric"),
        F.coalesce(share >= 0.9, F.lit(False)).alias("severe_imbalance"),
    )


def data_warnings(profile: DataFrame, target: str) -> DataFrame:
    """(warning, value): too few rows, too many features, gaps or imbalance in the target."""
    features = feature_selection(profile, target).agg(F.count_if("used").alias("n_features"))
    row = (
        profile.where(F.col("column") == target)
        .select("n_total", "missing_pct").withColumn("k", F.lit(1))
        .join(features.withColumn("k", F.lit(1)), "k")
        .join(target_balance(profile, target).select("top_share").withColumn("k", F.lit(1)), "k")
    )
    n, k = F.col("n_total"), F.col("n_features")
    checks = [
        ("very_few_rows", n < 50, n),
        ("few_rows", (n >= 50) & (n < 200), n),
        ("many_features", (k > 0) & (k > n / 10), k),
        ("target_gaps", F.col("missing_pct") > 0, F.col("missing_pct")),
        ("severe_imbalance", F.col("top_share") >= 0.9, F.col("top_share")),
    ]
    listed = F.array(*[F.struct(F.lit(w).alias("warning"), test.alias("on"), v.cast("double").alias("value")) for w, test, v in checks])
    return row.select(F.inline(listed)).where("on").select("warning", "value")


@dataclass(frozen=True)
class Candidate:
    name: str
    rank: int
    baseline: bool = False


def candidate_models(problem_type: str, n_rows: int) -> list[Candidate]:
    """Models worth trying, simplest first; boosting needs 500 rows."""
    if problem_type == "unknown":
        return []
    classes = problem_type != "regression"
    names = ["logistic_regression" if classes else "linear_regression", "decision_tree", "random_forest"]
    if n_rows >= 500:
        names.append("gradient_boosting")
    return [Candidate(n, i + 1, i == 0) for i, n in enumerate(names)]


@dataclass
class Plan:
    target: str
    problem_type: str
    numeric: list[str]
    categorical: list[str]
    candidates: list[Candidate]
    primary_metric: str
    other_metrics: list[str]
    n_folds: int = 5

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    @property
    def metrics(self) -> list[str]:
        return [self.primary_metric, *self.other_metrics]


def modelling_plan(df: DataFrame, target: str, profile: Profile | None = None, n_folds: int = 5) -> Plan:
    profile = profile_of(df, profile)
    kinds = {r["column"]: r["problem_type"] for r in problem_types(profile.frame).collect()}
    kind = kinds.get(target, "unknown")
    roles = feature_selection(profile.frame, target).orderBy("position").collect()
    if kind == "regression":
        primary, others = "rmse", ["mae", "r2"]
    else:
        balance = target_balance(profile.frame, target).first()
        primary = balance["primary_metric"] if balance else "accuracy"
        others = [m for m in ("accuracy", "f1", "roc_auc", "precision", "recall") if m != primary]
    return Plan(
        target, kind, [r["column"] for r in roles if r["role"] == "numeric"],
        [r["column"] for r in roles if r["role"] == "categorical"], candidate_models(kind, profile.n_rows), primary, others, n_folds,
    )


# ---- the frame every model works on ---------------------------------------------------------


def model_frame(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows with a target: `row`, `label` and the features, written down once.

    Numbers are doubles and labels are text. The row number must not change between the many
    jobs that read the frame, hence the written copy.
    """
    t = present(df, plan.target)
    label = t.cast("double") if plan.problem_type == "regression" else t.cast("string")
    chosen = df.select(
        label.alias("label"),
        *[present(df, c).cast("double").alias(c) for c in plan.numeric],
        *[present(df, c).cast("string").alias(c) for c in plan.categorical],
    ).where(F.col("label").isNotNull())
    return cut_lineage(spread(chosen).select(F.monotonically_increasing_id().alias("row"), "*"))


def usable_folds(frame: DataFrame, plan: Plan) -> int:
    """Never more folds than the rarest class has rows, never fewer than two."""
    if plan.problem_type == "regression":
        rarest = frame.count()
    else:
        rarest = frame.groupBy("label").count().agg(F.min("count").alias("least")).first()["least"]
    return max(2, min(plan.n_folds, rarest or 0))


def with_folds(frame: DataFrame, plan: Plan, k: int, seed: int = 42) -> DataFrame:
    """Add `fold`: sizes differ by at most one, for classes also within each class."""
    group = [] if plan.problem_type == "regression" else ["label"]
    placed = positions_within(frame, group, F.xxhash64("row", F.lit(seed)), frame.count())
    return placed.withColumn("fold", F.pmod("position", F.lit(k)).cast("int")).drop("position")


# ---- training -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Model parameters; trees of depth 30 are the deepest Spark builds.

    A leaf of a deep tree holds at least the share `least_leaf` of the training rows, at every size: single rows up to 2,000, and
    trees that stay small enough to send to executors beyond. `at_once` fits run side by side, more where `rows_per_task` leaves a fit
    fewer tasks than there are cores.
    """

    max_depth: int = 30
    least_leaf: float = 1 / 2000
    histogram_mb: int = 1024
    at_once: int = 4
    rows_per_task: int = 50_000
    n_trees: int = 100
    boosting_rounds: int = 100
    boosting_depth: int = 3
    learning_rate: float = 0.1
    max_iter: int = 1000
    max_bins: int = 32
    seed: int = 42


def needs_scaling(model: str) -> bool:
    return model in ("logistic_regression", "linear_regression")


def estimator(model: str, plan: Plan, n_train: int, n_classes: int, s: Settings):
    common = {"featuresCol": "features", "labelCol": "target"}
    # node ids travel with the rows, so no pass sends the trees grown so far
    trees = {
        **common, "maxDepth": s.max_depth, "maxBins": s.max_bins, "seed": s.seed, "minWeightFractionPerNode": s.least_leaf,
        "maxMemoryInMB": s.histogram_mb, "cacheNodeIds": True,
    }
    regression = plan.problem_type == "regression"
    if model == "linear_regression":
        return LinearRegression(**common, regParam=0.0, maxIter=s.max_iter)
    if model == "logistic_regression":
        # an L2 penalty of one over all rows
        return LogisticRegression(
            **common, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, maxIter=s.max_iter
        )
    if model == "decision_tree":
        return (DecisionTreeRegressor if regression else DecisionTreeClassifier)(**trees)
    if model == "random_forest":
        forest = {**trees, "numTrees": s.n_trees}
        if regression:
            return RandomForestRegressor(**forest, featureSubsetStrategy="all")
        return RandomForestClassifier(**forest, featureSubsetStrategy="sqrt")
    if model == "gradient_boosting":
        boost = {
            **common, "maxDepth": s.boosting_depth, "maxIter": s.boosting_rounds, "stepSize": s.learning_rate,
            "maxBins": s.max_bins, "seed": s.seed,
        }
        if regression:
            return GBTRegressor(**boost)
        if n_classes == 2:
            return GBTClassifier(**boost)
        return OneVsRest(classifier=GBTClassifier(**boost), featuresCol="features", labelCol="target")
    raise ValueError(f"Unknown model: {model!r}")


def gap_fills(train: DataFrame, plan: Plan, columns_with_gaps: set[str]) -> dict[str, float | str]:
    """Median of numbers and most frequent label (ties to the smallest), from training rows only."""
    fills: dict[str, float | str] = {}
    numeric = [c for c in plan.numeric if c in columns_with_gaps]
    labels = [c for c in plan.categorical if c in columns_with_gaps]
    if numeric:
        fills |= {c: v[0] for c, v in exact_quantiles(train, {c: [0.5] for c in numeric}).items() if v[0] is not None}
    if labels:
        leaders = spell_out(train, leading_values(value_counts(train, labels, "label"), 1), labels).collect()
        fills |= {r["column"]: r["value"] for r in leaders}
    return fills


class FittedModel:
    """Gap fills, encodings and the model, all learned from the same training rows."""

    def __init__(self, plan: Plan, fills: dict, stages, classes: list[str]):
        self.plan, self.fills, self.stages, self.classes = plan, fills, stages, classes

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add `prediction` (class index or value) and `scores` (one per class; NULL for regression)."""
        out = self.stages.transform(filled(frame, self.plan, self.fills))
        if self.plan.problem_type == "regression":
            scores = F.lit(None).cast("array<double>")
        else:
            source = "probability" if "probability" in out.columns else "rawPrediction"
            scores = vector_to_array(F.col(source))
        keep = [c for c in frame.columns]
        return out.select(*[col(c) for c in keep], "prediction", scores.alias("scores"))

    @property
    def has_probability(self) -> bool:
        return self.plan.problem_type != "regression" and not type(self.stages.stages[-1]).__name__.startswith("OneVsRest")


def filled(frame: DataFrame, plan: Plan, fills: dict) -> DataFrame:
    return frame.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fills.items()}) if fills else frame


def class_labels(frame: DataFrame) -> list[str]:
    """Class labels in order; a classifier keeps one output for each of them."""
    return [r["label"] for r in frame.select("label").distinct().orderBy("label").collect()]


def fit_model(
    model: str, train: DataFrame, plan: Plan, classes: list[str], columns_with_gaps: set[str], settings: Settings = Settings()
) -> FittedModel:
    fills = gap_fills(train, plan, columns_with_gaps)
    ready = filled(train, plan, fills)
    if plan.problem_type == "regression":
        ready = ready.withColumn("target", F.col("label"))
    else:
        order = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
        ready = ready.withColumn("target", order[F.col("label")])
    # numbers without any present training value cannot be filled and are left out
    numeric = [c for c in plan.numeric if c not in columns_with_gaps or c in fills]
    labels = plan.categorical
    stages, parts = [], []
    if labels:
        indexed, coded = [f"{c}__index" for c in labels], [f"{c}__flags" for c in labels]
        stages.append(StringIndexer(inputCols=labels, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # the bucket of unseen and missing labels comes last and is dropped: they are all zeros
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
        parts += coded
    if model == "linear_regression":
        flags = Pipeline(stages=stages).fit(ready)
        known = dict(zip(labels, flags.stages[0].labelsArray)) if labels else {}
        if sum(len(v) for v in known.values()) + len(numeric) <= MOST_PLACES:
            given = {c: (col(c), list(v)) for c, v in known.items()}
            whole = moments_by(ready, F.lit(0), given, [col(c) for c in numeric], F.col("target"))[0]
            return FittedModel(plan, fills, PipelineModel([*flags.stages, *line_stages(ready.sparkSession, plan, known, numeric, whole, settings)]), classes)
    if numeric:
        stages.append(VectorAssembler(inputCols=numeric, outputCol="__numbers", handleInvalid="keep"))
        if needs_scaling(model):
            stages.append(StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True))
            parts.append("__scaled")
        else:
            parts.append("__numbers")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    n_train = ready.count() if model == "logistic_regression" else 0
    stages.append(estimator(model, plan, n_train, len(classes), settings))
    return FittedModel(plan, fills, Pipeline(stages=stages).fit(ready), classes)


def line_stages(spark: SparkSession, plan: Plan, labels: dict[str, list[str]], numeric: list[str], m: Moments, settings: Settings) -> list:
    """The fitted stages of a linear regression behind the flags of its labels, from the moments of its training rows.

    Least squares sees no more of the rows than these, so Spark ML gets a few points that have the same fit.
    """
    points, at, columns = plane_points(m), 0, {}
    for name, width in [*((f"{c}__flags", len(v)) for c, v in labels.items()), *([("__numbers", len(numeric))] if numeric else [])]:
        columns[name] = points[:, at : at + width]
        at += width
    rows = [(*[Vectors.dense(v[r]) for v in columns.values()], float(points[r, -1])) for r in range(len(points))]
    schema = StructType([*[StructField(c, VectorUDT()) for c in columns], StructField("target", DoubleType())])
    stages, parts = [], [c for c in columns if c != "__numbers"]
    if numeric:
        stages += [
            VectorAssembler(inputCols=numeric, outputCol="__numbers", handleInvalid="keep"),
            StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True),
        ]
        parts.append("__scaled")
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), estimator("linear_regression", plan, m.n, 0, settings)]
    own = stages[1:] if numeric else stages  # the points come with their numbers assembled
    fitted = Pipeline(stages=own).fit(spark.createDataFrame(rows, schema).coalesce(1)).stages
    return [*stages[: len(stages) - len(own)], *fitted]


def line_weights(stages: list, labels: dict[str, list[str]], numeric: list[str]) -> tuple[float, dict[str, dict[str, float]], dict[str, float]]:
    """Intercept, weight of each label of each column and weight of each number (as it came, not scaled) of a linear regression."""
    weights, intercept = stages[-1].coefficients.toArray().tolist(), float(stages[-1].intercept)
    at, of_labels, of_numbers = 0, {}, {}
    for c, own in labels.items():
        of_labels[c] = dict(zip(own, weights[at : at + len(own)]))
        at += len(own)
    if numeric:
        scaler = stages[1 if len(stages) > 3 else 0]
        for c, w, mean, std in zip(numeric, weights[at:], scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()):
            of_numbers[c] = w / std if std else 0.0
            intercept -= of_numbers[c] * mean
    return intercept, of_labels, of_numbers


# ---- all folds together ---------------------------------------------------------------------


def _outside_counts(folded: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(column, value, t0, t1, ..): how often a value stands outside each fold.

    One pass counts (column, value) with a tally for each fold; the training part of a fold is the total less its tally.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    return (
        folded.select("fold", F.inline(cells)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(*[F.count_if(F.col("fold") != i).alias(f"t{i}") for i in range(k)])
    )


def _outside_medians(counts: DataFrame, k: int) -> DataFrame:
    """(column, fold, fill): exact medians of the training part of every fold, from one set of running sums."""
    tallies = [f"t{i}" for i in range(k)]
    sizes = counts.groupBy("column").agg(*[F.sum(t).alias(f"all_{t}") for t in tallies])  # one row for each column
    placed = running_totals(counts, "column", "value", tallies).join(F.broadcast(sizes), "column")

    def holds(i: int, rank: Column) -> Column:
        before = F.col(f"before_t{i}")
        return (before <= rank) & (rank < before + F.col(f"t{i}"))

    def middle(i: int) -> Column:
        size = F.col(f"all_t{i}")
        return (F.col(f"t{i}") > 0) & (holds(i, F.floor((size - 1) / 2)) | holds(i, F.floor(size / 2)))

    found = F.array_compact(F.array(*[F.when(middle(i), F.lit(i)) for i in range(k)]))
    ends = placed.select("column", "value", F.explode(found).alias("fold")).groupBy("column", "fold").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    return ends.select("column", "fold", (F.col("low") + (F.col("high") - F.col("low")) * 0.5).alias("fill"))


def _outside_modes(counts: DataFrame, k: int) -> DataFrame:
    """(column, fold, fill): the most frequent label of the training part of every fold, ties to the smallest."""
    first = lambda t: F.min(F.when(F.col(t) > 0, F.struct((-F.col(t)).alias("n"), F.col("value").alias("v"))))["v"]
    wide = counts.groupBy("column").agg(*[first(f"t{i}").alias(f"m{i}") for i in range(k)])
    return wide.select(
        "column", F.inline(F.array(*[F.struct(F.lit(i).alias("fold"), F.col(f"m{i}").alias("fill")) for i in range(k)]))
    ).where("fill IS NOT NULL")


def fold_fills(folded: DataFrame, plan: Plan, k: int, columns_with_gaps: set[str]) -> DataFrame:
    """(column, fold, number, label): what fills gaps where a fold is held out, for all folds in one count each of numbers and labels."""
    numeric = [c for c in plan.numeric if c in columns_with_gaps]
    labels = [c for c in plan.categorical if c in columns_with_gaps]
    parts = []
    if numeric:
        medians = _outside_medians(_outside_counts(folded, numeric, k), k)
        parts.append(medians.select("column", "fold", F.col("fill").alias("number"), F.lit(None).cast("string").alias("label")))
    if labels:
        modes = _outside_modes(_outside_counts(folded, labels, k), k)
        parts.append(modes.select("column", "fold", F.lit(None).cast("double").alias("number"), F.col("fill").alias("label")))
    if not parts:
        return folded.sparkSession.createDataFrame([], "column string, fold int, number double, label string")
    return union_all(parts)


def fold_labels(folded: DataFrame, plan: Plan, k: int) -> DataFrame:
    """(column, fold, labels): the labels in the training part of every fold, in order."""
    counts = _outside_counts(folded, plan.categorical, k)
    present_in = F.array_compact(F.array(*[F.when(F.col(f"t{i}") > 0, F.lit(i)) for i in range(k)]))
    return counts.select("column", "value", F.explode(present_in).alias("fold")).groupBy("column", "fold").agg(
        F.sort_array(F.collect_set("value")).alias("labels")
    )


@dataclass
class Encoding:
    """What is learned from the training part of a fold before a model is: gap fills and label sets."""

    fills: dict[str, float | str]
    labels: dict[str, list[str]]


def fold_encodings(folded: DataFrame, plan: Plan, k: int, columns_with_gaps: set[str]) -> list[Encoding]:
    out = [Encoding({}, {}) for _ in range(k)]
    for r in fold_fills(folded, plan, k, columns_with_gaps).collect():  # one row for each fold and column
        out[r["fold"]].fills[r["column"]] = r["number"] if r["label"] is None else r["label"]
    if plan.categorical:
        for r in fold_labels(folded, plan, k).collect():
            out[r["fold"]].labels[r["column"]] = r["labels"]
    return out


def encoded(frame: DataFrame, plan: Plan, classes: list[str], columns_with_gaps: set[str], e: Encoding) -> DataFrame:
    """(row, fold, label, target, and the vectors flags and numbers) of all rows, by an encoding.

    A label that the training part lacks has no flag; a number that it cannot fill is left out.
    """
    ready = filled(frame, plan, e.fills)
    target = F.col("label") if plan.problem_type == "regression" else class_index(classes, F.col("label"))
    ready = ready.withColumn("target", target)
    vectors = []
    labels = [c for c in plan.categorical if e.labels.get(c)]
    if labels:
        indexed, coded = [f"{c}__index" for c in labels], [f"{c}__flags" for c in labels]
        places = ready
        for c, name in zip(labels, indexed):
            places = StringIndexerModel.from_labels(e.labels[c], c, name, "keep").transform(places)
        # sizes come with the columns, so nothing is scanned here
        flags = OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True).fit(places).transform(places)
        ready = VectorAssembler(inputCols=coded, outputCol="flags").transform(flags)
        vectors.append("flags")
    numeric = [c for c in plan.numeric if c not in columns_with_gaps or c in e.fills]
    if numeric:
        ready = VectorAssembler(inputCols=numeric, outputCol="numbers", handleInvalid="keep").transform(ready)
        vectors.append("numbers")
    return ready.select("row", "fold", "label", "target", *vectors)


def together(spark: SparkSession, jobs: list[Callable], at_once: int) -> list:
    """Results of jobs that the driver submits from `at_once` threads; a fair scheduler shares the cores among them.

    The exception of a job that failed stands in its place, for callers that report it and go on; others use `all_together`.
    """

    def run(job: Callable):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", "folds")
        try:
            return job()
        except Exception as problem:  # noqa: BLE001 - the caller decides
            return problem

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(functools.partial(run, job))) for job in jobs]
        return [w.result() for w in waiting]


def all_together(spark: SparkSession, jobs: list[Callable], at_once: int) -> list:
    """Like `together`, but a job that failed is an error, raised when the others have ended."""
    out = together(spark, jobs, at_once)
    for problem in out:
        if isinstance(problem, Exception):
            raise problem
    return out


def line_predictions(
    folded: DataFrame, plan: Plan, k: int, columns_with_gaps: set[str], encodings: list[Encoding], settings: Settings = Settings()
) -> DataFrame:
    """(row, fold, label, prediction, scores) of all folds, each by a linear regression of the others.

    One pass sums up the moments of every fold, one for each different encoding; the training part of a fold is the folds but it. A prediction is
    a sum of the row's own columns with the weights of its fold, so nothing is written.
    """
    usable = [[c for c in plan.numeric if c not in columns_with_gaps or c in e.fills] for e in encodings]
    different = [i for i, e in enumerate(encodings) if e not in encodings[:i]]

    def moments(i: int) -> dict[int, Moments]:
        ready = filled(folded, plan, encodings[i].fills)
        given = {c: (col(c), encodings[i].labels[c]) for c in plan.categorical if encodings[i].labels.get(c)}
        return moments_by(ready, F.col("fold"), given, [col(c) for c in usable[i]], F.col("label"))

    spark = folded.sparkSession
    seen = dict(zip(different, all_together(spark, [functools.partial(moments, i) for i in different], settings.at_once)))

    def weights(i: int):
        own = seen[next(j for j in different if encodings[j] == encodings[i])]
        labels = {c: encodings[i].labels[c] for c in plan.categorical if encodings[i].labels.get(c)}
        train = joined([m for f, m in own.items() if f != i])
        return line_weights(line_stages(spark, plan, labels, usable[i], train, settings), labels, usable[i])

    lines = all_together(spark, [functools.partial(weights, i) for i in range(k)], settings.at_once)

    def of_fold(values: list, kind: str) -> Column:
        return F.get(F.lit(values).cast(f"array<{kind}>") if any(v is not None for v in values) else F.lit(None).cast(f"array<{kind}>"), F.col("fold"))

    prediction = of_fold([line[0] for line in lines], "double")
    for c in plan.numeric:
        value = F.coalesce(col(c), of_fold([e.fills.get(c) for e in encodings], "double")) if c in columns_with_gaps else col(c)
        prediction = prediction + F.coalesce(value * of_fold([line[2].get(c, 0.0) for line in lines], "double"), F.lit(0.0))
    for c in plan.categorical:
        value = F.coalesce(col(c), of_fold([e.fills.get(c) for e in encodings], "string")) if c in columns_with_gaps else col(c)
        known = sorted({v for line in lines for v in line[1].get(c, {})})
        if known:
            by_label = F.create_map(*[x for v in known for x in (F.lit(v), F.lit([line[1].get(c, {}).get(v, 0.0) for line in lines]))])
            prediction = prediction + F.coalesce(F.get(by_label[value], F.col("fold")), F.lit(0.0))
    return folded.select("row", "fold", "label", prediction.alias("prediction"), F.lit(None).cast("array<double>").alias("scores"))


def prepared_folds(
    folded: DataFrame, plan: Plan, k: int, classes: list[str], columns_with_gaps: set[str], at_once: int = 4,
    encodings: list[Encoding] | None = None,
) -> list[DataFrame]:
    """The vectors of all rows for every held-out fold, written once for all models and all folds with the same encoding."""
    encodings = fold_encodings(folded, plan, k, columns_with_gaps) if encodings is None else encodings
    different = [e for i, e in enumerate(encodings) if e not in encodings[:i]]
    jobs = [lambda e=e: cut_lineage(encoded(folded, plan, classes, columns_with_gaps, e)) for e in different]
    out = all_together(folded.sparkSession, jobs, at_once)
    return [out[different.index(e)] for e in encodings]


# ---- training rows that trees cannot tell apart ---------------------------------------------


GROUPED = ("decision_tree", "gradient_boosting")  # a forest draws each row on its own, so it keeps them apart


@dataclass
class Groups:
    """The training rows of a fold by class, flags and bins of the numbers, with how many they are; `cuts` part the bins."""

    frame: DataFrame
    cuts: list[list[float]]
    n_train: int


def fold_cuts(vectors: DataFrame, k: int, max_bins: int) -> list[list[list[float]]]:
    """For each fold and number, the values where a bin of its training part begins.

    Up to `max_bins` different values have a bin each. More are dealt by the rows below their middle row, so bins have about equal
    shares and a value is never split. A cut lies midway between the values beside it.
    """
    if "numbers" not in vectors.columns:
        return [[] for _ in range(k)]
    rows, values = [f"t{i}" for i in range(k)], [f"d{i}" for i in range(k)]
    counts = (
        vectors.select("fold", F.posexplode(vector_to_array("numbers")).alias("place", "value"))
        .groupBy("place", "value").agg(*[F.count_if(F.col("fold") != i).alias(t) for i, t in enumerate(rows)])
        .withColumns({d: (F.col(t) > 0).cast("bigint") for t, d in zip(rows, values)})
    )
    placed = running_totals(counts, "place", "value", rows + values)
    sizes = placed.groupBy("place").agg(*[F.sum(c).alias(f"all_{c}") for c in rows + values])  # one row for each number

    def bin_of(i: int) -> Column:
        dealt = F.ceil((2 * F.col(f"before_t{i}") + F.col(f"t{i}")) * F.lit(max_bins) / (2 * F.col(f"all_t{i}"))) - 1
        return F.when(F.col(f"t{i}") > 0, F.when(F.col(f"all_d{i}") <= max_bins, F.col(f"before_d{i}")).otherwise(dealt))

    bins = F.array(*[F.struct(F.lit(i).alias("fold"), bin_of(i).cast("bigint").alias("bin")) for i in range(k)])
    ends = placed.join(F.broadcast(sizes), "place").select("place", "value", F.inline(bins)).where("bin IS NOT NULL")
    ends = ends.groupBy("place", "fold", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    found: dict[tuple[int, int], list] = {}
    for r in ends.orderBy("place", "fold", "bin").collect():  # at most max_bins rows for each number and fold
        found.setdefault((r["fold"], r["place"]), []).append(r)
    places = 1 + max((place for _, place in found), default=-1)
    return [[_midways(found[i, p]) for p in range(places)] for i in range(k)]


def _midways(bins: list) -> list[float]:
    cuts = []
    for before, after in zip(bins, bins[1:]):
        middle = before["high"] / 2 + after["low"] / 2
        cuts.append(middle if before["high"] < middle < math.inf else after["low"])
    return [c for c in cuts if math.isfinite(c)]


def binned(vectors: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """Add the vector `bins`: for every number of a row the bin it falls into."""
    if "numbers" not in vectors.columns:
        return vectors
    numbers, bins = [f"__number{p}" for p in range(len(cuts))], [f"__bin{p}" for p in range(len(cuts))]
    ends = [[-math.inf, *(c or [0.0]), math.inf] for c in cuts]  # a constant number has one bin, wherever it is cut
    apart = vectors.withColumn("__numbers", vector_to_array("numbers"))
    apart = apart.select(*vectors.columns, *[F.col("__numbers")[p].alias(c) for p, c in enumerate(numbers)])
    placed = Bucketizer(splitsArray=ends, inputCols=numbers, outputCols=bins, handleInvalid="keep").transform(apart)
    # a bucket counts as a category unless told otherwise, and trees would split bins regardless of their order
    ordered = placed.withColumns({c: F.col(c).alias(c, metadata={"ml_attr": {"type": "numeric"}}) for c in bins})
    return VectorAssembler(inputCols=bins, outputCol="bins").transform(ordered).select(*vectors.columns, "bins")


def grouped_folds(prepared: list[DataFrame], k: int, max_bins: int, at_once: int = 4) -> list[Groups]:
    """The groups of every fold's training rows, written once for the models that take them.

    Trees on at most `max_bins` bins see no more of a row than its group, so a weighted group has the same sums as its rows, while
    the many passes of a fit grow with the number of groups and not with the rows.
    """
    cuts: dict[int, list] = {}
    for vectors in prepared:
        if id(vectors) not in cuts:
            cuts[id(vectors)] = fold_cuts(vectors, k, max_bins)

    def group(i: int) -> Groups:
        own = cuts[id(prepared[i])][i]
        train = binned(prepared[i].where(F.col("fold") != i), own)
        parts = [c for c in ("flags", "bins") if c in train.columns]
        frame = cut_lineage(train.groupBy("target", *parts).agg(F.count(F.lit(1)).cast("double").alias("weight")))
        return Groups(frame, own, int(frame.agg(F.sum("weight")).first()[0] or 0))

    return all_together(prepared[0].sparkSession, [functools.partial(group, i) for i in range(k)], at_once)


def fit_tasks(n_train: int, cores: int, rows_per_task: int) -> int:
    """How many tasks a pass of a fit gets: every task sends histograms of all nodes, so a few rows are not dealt to all cores."""
    return max(1, min(cores, math.ceil(n_train / rows_per_task)))


def dealt_for_fit(train: DataFrame, model: str, plan: Plan, n_train: int, settings: Settings) -> DataFrame:
    """Training rows in tasks of a size that suits them, for tree regressions in the order of the target.

    Neighbours in that order fall into the same nodes, so a task updates histograms that its cache still holds.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = fit_tasks(n_train, cores, settings.rows_per_task)
    dealt = spread(train) if tasks == cores else train.repartition(tasks)
    return dealt.sortWithinPartitions("target") if plan.problem_type == "regression" and not needs_scaling(model) else dealt


def fold_predictions(
    model: str, vectors: DataFrame, i: int, plan: Plan, classes: list[str], settings: Settings = Settings(), groups: Groups | None = None
) -> DataFrame:
    """(row, fold, label, prediction, scores) of fold i, by a model of the other folds: of their rows or, if given, their groups."""
    held, stages = vectors.where(F.col("fold") == i), []
    if groups is None:
        rest = vectors.where(F.col("fold") != i)
        n_train = rest.count()
        train = dealt_for_fit(rest, model, plan, n_train, settings)
    else:
        held, n_train = binned(held, groups.cuts), groups.n_train
        train = dealt_for_fit(groups.frame, model, plan, groups.frame.count(), settings)
    parts = [c for c in ("flags", "numbers" if groups is None else "bins") if c in train.columns]
    if needs_scaling(model) and "numbers" in parts:
        stages.append(StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True))
        parts[-1] = "scaled"
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    last = estimator(model, plan, n_train, len(classes), settings)
    stages.append(last if groups is None else last.setWeightCol("weight"))
    fitted = FittedModel(plan, {}, Pipeline(stages=stages).fit(train), classes)
    return cut_lineage(fitted.predict(held).select("row", "fold", "label", "prediction", "scores"))


def in_phases(spark: SparkSession, jobs: dict[tuple[str, int], Callable], at_once: int) -> dict[tuple[str, int], object]:
    """Results of the jobs of (model, fold): all folds of boosting side by side first, then the other models from `at_once` threads.

    Boosting is a long chain of short jobs, each of which would wait for the long tasks of a forest beside it.
    """
    chains = [key for key in jobs if key[0] == "gradient_boosting"]
    others = [key for key in jobs if key not in chains]
    done = {}
    for keys, threads in ((chains, max(at_once, len(chains))), (others, at_once)):
        done |= dict(zip(keys, together(spark, [jobs[key] for key in keys], threads)))
    return done


# ---- scores ---------------------------------------------------------------------------------


def class_index(classes: list[str], c: Column) -> Column:
    return F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])[c]


def regression_scores(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rmse, mae, r2) per group."""
    gap = F.col("label") - F.col("prediction")
    return predictions.groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop("label") * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
    )


def class_scores(predictions: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """(keys, accuracy, f1, precision, recall) per group, weighted by class size.

    One shuffle counts (label, prediction) cells; the rest is arithmetic on those cells.
    """
    cells = (
        predictions.groupBy(*keys, class_index(classes, F.col("label")).alias("actual"), F.col("prediction").alias("guess"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit = F.when(F.col("actual") == F.col("guess"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), hit.cast("bigint").alias("hits"), F.col("n").alias("size"), zero.alias("guesses")),
        F.struct(F.col("guess").alias("class"), zero.alias("hits"), zero.alias("size"), F.col("n").alias("guesses")),
    )
    per_class = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        F.sum("hits").alias("hits"), F.sum("size").alias("size"), F.sum("guesses").alias("guesses")
    )
    precision = F.coalesce(F.col("hits") / F.nullif(F.col("guesses"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("hits") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    total = F.sum("size")
    return per_class.groupBy(*keys).agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(F.col("size") * f1) / total).alias("f1"),
        (F.sum(F.col("size") * precision) / total).alias("precision"),
        (F.sum(F.col("size") * recall) / total).alias("recall"),
    )


def ranking_scores(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """(fold, roc_auc): rank-sum AUC; with more than two classes, one against the rest by class share.

    Scores are tallied before they are ranked, so tied scores cost one row.
    """
    wanted = [1] if len(classes) == 2 else list(range(len(classes)))
    unfolded = predictions.select(
        "fold", class_index(classes, F.col("label")).alias("actual"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("class"), F.col("scores")[i].alias("score")) for i in wanted])),
    )
    tallies = unfolded.groupBy((F.col("fold") * len(classes) + F.col("class")).alias("group"), "score").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("actual") == F.col("class")).alias("positives")
    )
    placed = running_total(tallies, "group", "score", "n")
    p, n = F.sum("positives"), F.sum("n")
    rank_sum = F.sum(F.col("positives") * (F.col("before") + (F.col("n") + 1) / 2))
    per_class = placed.groupBy("group").agg(
        F.floor(F.first("group") / len(classes)).cast("int").alias("fold"), p.alias("p"), n.alias("all"), rank_sum.alias("rank_sum")
    )
    q = F.col("all") - F.col("p")
    auc = (F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p").cast("double") * q, F.lit(0.0))
    return per_class.withColumn("auc", auc).where("auc IS NOT NULL").groupBy("fold").agg(
        (F.sum(F.col("auc") * F.col("p")) / F.sum("p")).alias("roc_auc")
    )


def fold_scores(predictions: DataFrame, plan: Plan, classes: list[str]) -> DataFrame:
    """(fold, metric, value) of held-out predictions, all folds at once."""
    if plan.problem_type == "regression":
        wide = regression_scores(predictions, ["fold"])
    else:
        wide = class_scores(predictions, ["fold"], classes)
        if "roc_auc" in plan.metrics:
            wide = wide.join(ranking_scores(predictions, classes), "fold", "left")
    return wide.unpivot(["fold"], [m for m in plan.metrics if m in wide.columns], "metric", "value")


SCORES = "model string, rank int, is_baseline boolean, fold int, metric string, value double, seconds double"


@dataclass
class Experiment:
    plan: Plan
    frame: DataFrame
    classes: list[str]
    columns_with_gaps: set[str]
    n_folds: int
    scores: DataFrame
    predictions: dict[str, DataFrame] = field(default_factory=dict)
    failures: dict[str, str] = field(default_factory=dict)
    settings: Settings = Settings()

    def complete(self) -> Experiment:
        """This experiment, if every candidate was scored: for results in which a missing model would look like none was asked for."""
        if self.failures:
            told = "; ".join(f"{model}: {problem}" for model, problem in self.failures.items())
            raise RuntimeError(f"Models of '{self.plan.target}' failed: {told}")
        return self


def run_experiment(
    df: DataFrame, target: str, profile: Profile | None = None, plan: Plan | None = None, max_models: int = 4,
    settings: Settings = Settings(), models: list[str] | None = None,
) -> Experiment:
    """Cross-validate every candidate on the same folds; a model that fails does not stop the rest, but stands in `failures`.

    If all fail there is no result, and an error says why.

    All rows are used. Linear regressions come from the moments of the folds (`line_predictions`). Vectors of a fold are written once
    for all other models; of classes, boosting and the single tree take them in groups
    of rows that no bin tells apart (`grouped_folds`). The fits of boosting and then those of the other models are
    submitted side by side (`in_phases`), so short jobs of one fill the cores that another leaves idle.
    """
    profile = profile_of(df, profile)
    plan = plan or modelling_plan(df, target, profile)
    if plan.problem_type == "unknown" or not plan.features:
        raise ValueError(f"No model can be compared for '{target}': its type or its features rule it out.")
    frame = model_frame(df, plan)
    classes = [] if plan.problem_type == "regression" else class_labels(frame)
    gaps = {r["column"] for r in profile.rows if r["n_missing"] > 0}
    k = usable_folds(frame, plan)
    folded = cut_lineage(with_folds(frame, plan, k, settings.seed))
    result = Experiment(plan, folded, classes, gaps, k, df.sparkSession.createDataFrame([], SCORES), settings=settings)
    chosen = [c for c in plan.candidates if models is None or c.name in models][:max_models]
    encodings = fold_encodings(folded, plan, k, gaps)
    widest = max(sum(len(v) for v in e.labels.values()) for e in encodings) + len(plan.numeric)
    summed = [c.name for c in chosen if c.name == "linear_regression" and widest <= MOST_PLACES]
    by_rows = [c for c in chosen if c.name not in summed]
    prepared = prepared_folds(folded, plan, k, classes, gaps, settings.at_once, encodings) if by_rows else []
    grouped = [c.name for c in chosen if c.name in GROUPED and plan.problem_type != "regression"]
    groups = grouped_folds(prepared, k, settings.max_bins, settings.at_once) if grouped else []

    def job(c: Candidate, i: int):
        started = time.perf_counter()
        out = fold_predictions(c.name, prepared[i], i, plan, classes, settings, groups[i] if c.name in grouped else None)
        return out, time.perf_counter() - started

    cores = df.sparkSession.sparkContext.defaultParallelism
    idle = cores // fit_tasks(folded.count() * (k - 1) // k, cores, settings.rows_per_task)
    done = in_phases(
        df.sparkSession, {(c.name, i): functools.partial(job, c, i) for c in by_rows for i in range(k)}, max(settings.at_once, idle)
    )

    def lines():
        started = time.perf_counter()
        return line_predictions(folded, plan, k, gaps, encodings, settings), time.perf_counter() - started

    whole = dict(zip(summed, together(df.sparkSession, [lines for _ in summed], 1)))
    parts = []
    for c in chosen:
        own = [whole[c.name]] if c.name in whole else [done[c.name, i] for i in range(k)]
        problems = [p for p in own if isinstance(p, Exception)]
        if problems:
            result.failures[c.name] = str(problems[0])
            continue
        result.predictions[c.name] = union_all([p for p, _ in own])
        parts.append(
            fold_scores(result.predictions[c.name], plan, classes).select(
                F.lit(c.name).alias("model"), F.lit(c.rank).alias("rank"), F.lit(c.baseline).alias("is_baseline"), "fold",
                "metric", "value", F.lit(sum(t for _, t in own)).alias("seconds"),
            )
        )
    if parts:
        result.scores = cut_lineage(union_all(parts))
        return result
    return result.complete()


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation over the folds."""
    return scores.groupBy("model", "rank", "is_baseline", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_folds"),
        F.max("seconds").alias("seconds"),
    )


def best_model(summary: DataFrame, primary_metric: str) -> DataFrame:
    """One row: the winner by the primary metric and its lead over the baseline.

    The simpler model wins a tie.
    """
    sign = -1.0 if primary_metric in LOWER_IS_BETTER else 1.0
    own = summary.where(F.col("metric") == primary_metric)
    order = F.struct(F.col("mean") * sign, -F.col("rank"))
    won = own.agg(F.max_by(F.struct("model", "mean", "is_baseline"), order).alias("w")).select("w.*", F.lit(1).alias("k"))
    base = own.where("is_baseline").select(F.col("model").alias("baseline"), F.col("mean").alias("baseline_mean"), F.lit(1).alias("k"))
    gain = (F.col("mean") - F.col("baseline_mean")) * sign
    return won.join(base, "k", "left").select(
        F.col("model").alias("best_model"), F.lit(primary_metric).alias("metric"), F.col("mean").alias("score"),
        "baseline", "baseline_mean", F.when(~F.col("is_baseline"), gain).alias("gain"),
        F.coalesce(~F.col("is_baseline") & (gain > 0), F.lit(False)).alias("beat_baseline"),
    )
