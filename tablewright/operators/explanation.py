"""Why the best model predicts what it does."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import col
from ..session import cut_lineage, spread
from .frequency import leading_values, spell_out, value_counts
from .modelling import Experiment, FittedModel, Plan, class_scores, filled, fit_model, regression_scores
from .ordering import exact_quantiles, hash_sample

# Rows per bucket of a shuffle: a bucket is one window partition.
SHUFFLE_BUCKET_ROWS = 100_000
# Cells of a tree model that are scored ahead; a table of them goes to every task.
MOST_CELLS = 1_000_000


def refit(experiment: Experiment, model: str) -> FittedModel:
    """The model trained on every usable row."""
    return fit_model(
        model, experiment.frame, experiment.plan, experiment.classes, experiment.columns_with_gaps, experiment.settings
    )


def _group_score(predictions: DataFrame, keys: list[str], plan: Plan, classes: list[str]) -> DataFrame:
    """(keys, score) where higher is better: minus RMSE, or the primary class metric."""
    if plan.problem_type == "regression":
        return regression_scores(predictions, keys).select(*keys, (-F.col("rmse")).alias("score"))
    return class_scores(predictions, keys, classes).select(*keys, F.col(plan.primary_metric).alias("score"))


def shuffled_donors(frame: DataFrame, features: list[str], n_rows: int, repeats: int, seed: int) -> DataFrame:
    """Every row once per repeat, with `donor`: the features of another random row.

    Each repeat deals the rows into random buckets and lines them up in random order inside
    their bucket; a row receives the values of the next one, the last those of the first. Every
    value is used exactly once per repeat, and no task sorts more than a bucket. The order is the MD5 of seed, repeat and row
    number as text, its first eight digits choose the bucket: any engine can repeat the shuffle.
    """
    buckets = max(1, math.ceil(n_rows / SHUFFLE_BUCKET_ROWS))
    repeated = frame.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "repeat", "row"))
    # bytes order like their hexadecimal digits and are half as long
    dealt = repeated.withColumns(
        {"__draw": F.unhex(draw), "__bucket": F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") % buckets}
    )
    line = Window.partitionBy("repeat", "__bucket").orderBy("__draw", "row")
    values = F.struct(*[col(c) for c in features])
    donor = F.coalesce(F.lead(values).over(line), F.first(values).over(line))
    return dealt.withColumn("donor", donor).drop("__draw", "__bucket")


def permutation_importance(
    experiment: Experiment, fitted: FittedModel, repeats: int = 5, seed: int = 42
) -> DataFrame:
    """(feature, importance, std, share): drop of the score when one column is shuffled.

    All features and repeats go through the model in one job; the mean and population standard
    deviation are over the repeats. A linear regression is a sum of one term for each feature: its terms are shuffled in the place
    of the values, and a shuffled column changes a prediction by the difference of two terms.
    """
    plan, frame = experiment.plan, experiment.frame.select("row", "label", *[col(c) for c in experiment.plan.features])
    if is_linear(fitted):
        base, scores = _shuffled_terms(frame, fitted, repeats, seed)
    else:
        base = _group_score(fitted.predict(frame.withColumn("all", F.lit(0))), ["all"], plan, experiment.classes).first()["score"]
        predicted = fitted.predict(_shuffled_variants(shuffled_donors(frame, plan.features, frame.count(), repeats, seed), plan.features))
        scores = _group_score(predicted, ["feature", "repeat"], plan, experiment.classes)
    drops = scores.groupBy("feature").agg(
        F.avg(F.lit(base) - F.col("score")).alias("importance"), F.stddev_pop(F.lit(base) - F.col("score")).alias("std")
    )
    return with_shares(drops)


def _shuffled_terms(frame: DataFrame, fitted: FittedModel, repeats: int, seed: int) -> tuple[float, DataFrame]:
    """Score of a linear regression, and (feature, repeat, score) with one of its terms shuffled; rows are not unfolded by features."""
    features = fitted.plan.features
    terms = [f"t{i}" for i in range(len(features))]
    told = with_terms(frame, fitted, ["label"]).select("row", (F.col("label") - F.col("prediction")).alias("__error"), *terms)
    n_rows, mean = told.agg(F.count(F.lit(1)), F.avg(F.col("__error") * F.col("__error"))).first()
    donors = shuffled_donors(told, terms, n_rows, repeats, seed).select(
        "repeat", *[(F.col("__error") + F.col(t) - F.col("donor")[t]).alias(f"e{i}") for i, t in enumerate(terms)]
    )
    means = donors.groupBy("repeat").agg(*[F.avg(F.col(f"e{i}") * F.col(f"e{i}")).alias(f"m{i}") for i in range(len(terms))])
    scores = F.array(*[F.struct(F.lit(f).alias("feature"), (-F.sqrt(F.col(f"m{i}"))).alias("score")) for i, f in enumerate(features)])
    return -math.sqrt(mean), means.select("repeat", F.inline(scores))


def _shuffled_variants(donors: DataFrame, features: list[str]) -> DataFrame:
    """Every row of `donors` once for each feature, with the donor's value of that feature."""
    return donors.select(
        "row", "label", "repeat",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        *[(F.col("donor")[c] if c == f else col(c)).alias(c) for c in features],
                    )
                    for f in features
                ]
            )
        ),
    )


def with_shares(importance: DataFrame) -> DataFrame:
    """Each feature's part of the positive importance; one row per feature, largest first."""
    gain = F.greatest("importance", F.lit(0.0))
    total = importance.agg(F.sum(gain).alias("total")).withColumn("k", F.lit(1))
    return (
        importance.withColumn("k", F.lit(1)).join(F.broadcast(total), "k")
        .withColumn("share", gain / F.when(F.col("total") > 0, F.col("total")).otherwise(1.0))
        .drop("k", "total").orderBy(F.desc("importance"), "feature")
    )


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def confusion_cells(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """(label, predicted, n) of held-out predictions, with a row for every pair of classes."""
    names = F.array(*[F.lit(c) for c in classes])
    seen = predictions.groupBy("label", F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = predictions.sparkSession.createDataFrame([(c,) for c in classes], "label string").withColumn(
        "predicted", F.explode(names)
    )
    return grid.join(seen, ["label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def positive_class(counts: DataFrame) -> DataFrame:
    """One row from (label, n): the rarer of two classes, else the most common; ties to the smaller label."""
    ranked = counts.agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("label", F.struct("n", "label")).alias("rarest"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("commonest"),
    )
    return ranked.select(F.when(F.col("k") == 2, F.col("rarest")).otherwise(F.col("commonest")).alias("positive_class"))


def label_counts(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def binary_outcomes(cells: DataFrame, positive: str) -> DataFrame:
    """One row: true and false negatives and positives, and accuracy."""
    actual, guess = F.col("label") == positive, F.col("predicted") == positive

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    return cells.agg(
        total(~actual & ~guess).alias("true_negative"), total(~actual & guess).alias("false_positive"),
        total(actual & ~guess).alias("false_negative"), total(actual & guess).alias("true_positive"),
        (total(actual == guess) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"),
    )


def prediction_number(fitted: FittedModel, positive: str | None) -> Column:
    """Probability of the positive class, else 1 or 0 for predicting it, else the value itself."""
    if positive is None:
        return F.col("prediction")
    place = fitted.classes.index(positive)
    if fitted.has_probability:
        return F.col("scores")[place]
    return (F.col("prediction") == place).cast("double")


def _positive(experiment: Experiment) -> str | None:
    if experiment.plan.problem_type == "regression":
        return None
    return positive_class(label_counts(experiment.frame)).first()["positive_class"]


def background_rows(experiment: Experiment, n: int = 100, seed: int = 42) -> DataFrame:
    """(place, features): n reference rows, numbered from 0."""
    drawn = hash_sample(experiment.frame, ["row"], n, seed)
    # at most n rows, so one window is enough
    return drawn.withColumn("place", F.row_number().over(Window.orderBy("row")) - 1).select(
        "place", F.struct(*[col(c) for c in experiment.plan.features]).alias("reference")
    )


def example_rows(experiment: Experiment, n: int) -> DataFrame:
    """The first n rows, for a report; without a choice of rows all of them are explained."""
    return experiment.frame.orderBy("row").limit(n)


def shapley_contributions(
    experiment: Experiment, fitted: FittedModel, rows: DataFrame | None = None, n_samples: int = 40,
    n_background: int = 100, seed: int = 42,
) -> DataFrame:
    """(row, feature, value, contribution, prediction, baseline) by sampled feature orders.

    Every (row, sample) draws a reference row and an order of the features, and reveals the
    row's own values one by one; the step in the prediction is the feature's credit. The
    baseline is the mean prediction of the references drawn for the row, so contributions add
    up to prediction minus baseline. All rows and samples are scored in one job, and a task sums up the steps of its rows.
    In a linear regression a step is the row's term less that of the reference in every order, so its steps are not walked one by one.
    Trees tell rows apart by the cell between their splits only: if these are at most `MOST_CELLS`, each is scored once and the steps look it up.
    """
    plan = experiment.plan
    features = plan.features
    rows = experiment.frame if rows is None else rows
    positive = _positive(experiment)
    reference = cut_lineage(background_rows(experiment, n_background, seed).coalesce(1))
    n_reference = reference.count()
    if is_linear(fitted):
        return _sampled_linear_contributions(fitted, rows, reference, n_reference, n_samples, seed)
    cells = tree_cells(fitted, prediction_number(fitted, positive))
    if cells is not None:
        return _sampled_cell_contributions(fitted, cells, rows, reference, n_reference, n_samples, seed)
    drawn = (
        rows.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
        .withColumn("place", drawn_place(F.col("sample"), n_reference, seed))
        .join(F.broadcast(reference), "place")
    )
    shuffled = F.array_sort(
        F.array(*[F.struct(drawn_order(F.col("sample"), i, seed).alias("h"), F.lit(i).alias("i")) for i in range(len(features))])
    )
    ordered = drawn.withColumn("order", F.transform(shuffled, lambda x: x["i"])).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(len(features))))
    )
    coalition = ordered.select(
        "row", "step", "label", F.get("order", F.col("step") - 1).alias("came"), F.get("order", F.col("step")).alias("next"),
        *[
            F.when(F.array_position("order", F.lit(i)) <= F.col("step"), col(c)).otherwise(F.col("reference")[c]).alias(c)
            for i, c in enumerate(features)
        ],
    )
    scored = fitted.predict(coalition).select("row", "step", "came", "next", prediction_number(fitted, positive).alias("number"))
    # the gain of a feature is the number after its step less the one before; the steps of a row are in one task, so partial sums are shuffled
    sums = scored.groupBy("row").agg(
        F.avg(F.when(F.col("step") == 0, F.col("number"))).alias("baseline"),
        *[
            (F.sum(F.when(F.col("came") == i, F.col("number"))) - F.sum(F.when(F.col("next") == i, F.col("number")))).alias(f"g{i}")
            for i in range(len(features))
        ],
    )
    own = fitted.predict(rows).select(
        "row", prediction_number(fitted, positive).alias("prediction"),
        F.array(*[col(c).cast("string") for c in features]).alias("values"),
    )
    listed = [
        F.struct(F.lit(c).alias("feature"), F.col("values")[i].alias("value"), (F.col(f"g{i}") / n_samples).alias("contribution"))
        for i, c in enumerate(features)
    ]
    return sums.join(own, "row").select("row", F.inline(F.array(*listed)), "prediction", "baseline")


def drawn_order(sample: Column, i: int, seed: int) -> Column:
    """A (row, sample) reveals its features in the order of these draws."""
    return F.xxhash64("row", sample, F.lit(i), F.lit(seed + 1))


def drawn_place(sample: Column, n_reference: int, seed: int) -> Column:
    """Which reference row a (row, sample) draws."""
    return F.pmod(F.xxhash64("row", sample, F.lit(seed)), F.lit(n_reference)).cast("int")


@dataclass
class Cells:
    """Where each feature's value lies among the splits of a tree model, and the model's score of every combination.

    `codes` is an expression over filled rows, an array with a place for each feature; a cell's score is at the sum of its codes times `strides`.
    """

    codes: Column
    strides: np.ndarray
    scores: np.ndarray


def tree_cells(fitted: FittedModel, number: Column) -> Cells | None:
    """The cells of a model of trees; None for other models and for trees with more than `MOST_CELLS` of them.

    A number has a place between any two thresholds that the trees split it by, at most a bin each of the fit; a label has its own, and
    unknown and missing ones share one.
    """
    model, plan = fitted.stages.stages[-1], fitted.plan
    if not hasattr(model, "toDebugString"):
        return None
    places = feature_places(fitted)
    cuts: dict[int, set[float]] = {}
    for place, value in set(re.findall(r"feature (\d+) <= ([^)]+)\)", model.toDebugString)):
        cuts.setdefault(int(place), set()).add(float(value))
    indexer = [s for s in fitted.stages.stages if isinstance(s, StringIndexerModel)]
    labels = dict(zip(plan.categorical, indexer[0].labelsArray)) if indexer else {}
    codes, values = [], []
    for c in plan.features:
        if c in labels:
            known = list(labels[c])
            code = F.coalesce(F.array_position(F.lit(known).cast("array<string>"), col(c)).cast("int"), F.lit(0)) if known else F.lit(0)
            own = ["?" * (1 + max(map(len, known), default=0)), *known]  # a label that is not known, and not a gap to be filled
        else:
            ends = sorted(cuts.get(places[c][0], ())) if c in places else []
            above = F.size(F.filter(F.lit(ends).cast("array<double>"), lambda end: end < col(c)))
            code = F.when(col(c).isNull(), len(ends)).otherwise(above) if ends else F.lit(0)
            own = [*ends, math.inf]  # a threshold belongs to the side below it
        codes.append(code)
        values.append(own)
    sizes = [len(v) for v in values]
    total = math.prod(sizes)
    if total > MOST_CELLS:
        return None
    strides = np.cumprod([1, *sizes[:-1]]).astype(np.int64)
    kinds = ["array<string>" if c in labels else "array<double>" for c in plan.features]
    grid = SparkSession.active().range(total).select(
        F.col("id").alias("row"),
        *[
            F.get(F.lit(v).cast(kind), (F.floor(F.col("id") / F.lit(int(s))) % F.lit(len(v))).cast("int")).alias(c)
            for c, v, s, kind in zip(plan.features, values, strides, kinds)
        ],
    )
    found = fitted.predict(grid).select("row", number.cast("double").alias("number")).toArrow()
    scores = np.empty(total)
    scores[found.column("row").to_numpy()] = found.column("number").to_numpy()
    return Cells(F.array(*[c.cast("int") for c in codes]), strides, scores)


def _walk_of_cells(held: np.ndarray, strides: np.ndarray, scores: np.ndarray, n_samples: int):
    """A function for `mapInArrow`: the mean step of every feature of a row over its samples."""
    size = len(strides)

    def walk(batches):
        for batch in batches:
            n = batch.num_rows
            own, at, drawn = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("__codes", "__places", "__draws")
            )
            gains, baseline = np.zeros((n, size)), np.zeros(n)
            every = np.arange(n)
            for s in range(n_samples):
                other = held[at[:, s]]
                change = (own - other) * strides
                cell = other @ strides
                before = scores[cell]
                baseline += before
                order = np.argsort(drawn[:, s * size : (s + 1) * size], axis=1, kind="stable")
                for step in range(size):
                    feature = order[:, step]
                    cell = cell + change[every, feature]
                    after = scores[cell]
                    gains[every, feature] += after - before
                    before = after
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * size, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("__given"), pa.ListArray.from_arrays(ends, pa.array((gains / n_samples).ravel())),
                    pa.array(scores[own @ strides]), pa.array(baseline / n_samples),
                ],
                ["row", "__given", "gains", "prediction", "baseline"],
            )

    return walk


def _sampled_cell_contributions(
    fitted: FittedModel, cells: Cells, rows: DataFrame, reference: DataFrame, n_reference: int, n_samples: int, seed: int
) -> DataFrame:
    """Contributions to a model of few cells: the same draws and orders as a walk through the model, with looked-up scores."""
    features = fitted.plan.features
    placed = filled(reference.select("place", "reference.*"), fitted.plan, fitted.fills).select("place", cells.codes.alias("codes"))
    held = np.array([r["codes"] for r in placed.orderBy("place").collect()], np.int64)  # n_background rows
    samples = F.sequence(F.lit(0), F.lit(n_samples - 1))
    draws = F.flatten(F.transform(samples, lambda s: F.array(*[drawn_order(s, i, seed) for i in range(len(features))])))
    given = filled(spread(rows), fitted.plan, fitted.fills).withColumn("__given", F.array(*[col(c).cast("string") for c in features]))
    ready = given.select(
        "row", "__given", cells.codes.alias("__codes"), F.transform(samples, lambda s: drawn_place(s, n_reference, seed)).alias("__places"),
        draws.alias("__draws"),
    )
    kind = dict(rows.dtypes)["row"]
    told = ready.mapInArrow(
        _walk_of_cells(held, cells.strides, cells.scores, n_samples),
        f"row {kind}, __given array<string>, gains array<double>, prediction double, baseline double",
    )
    listed = [
        F.struct(F.lit(c).alias("feature"), F.col("__given")[i].alias("value"), F.col("gains")[i].alias("contribution"))
        for i, c in enumerate(features)
    ]
    return told.select("row", F.inline(F.array(*listed)), "prediction", "baseline")


def _sampled_linear_contributions(
    fitted: FittedModel, rows: DataFrame, reference: DataFrame, n_reference: int, n_samples: int, seed: int
) -> DataFrame:
    """Contributions to a linear regression: a row's terms less the mean terms of the reference rows that its samples draw."""
    features = fitted.plan.features
    drawn = with_terms(reference.select(F.col("place").alias("row"), "reference.*"), fitted).orderBy("row").collect()  # n_background rows
    places = F.transform(F.sequence(F.lit(0), F.lit(n_samples - 1)), lambda s: drawn_place(s, n_reference, seed))

    held = np.array([[r[f"t{i}"] for i in range(len(features))] for r in drawn])

    @F.arrow_udf("array<double>")
    def mean_terms(batch: pa.Array) -> pa.Array:
        at = batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n_samples)
        means = sum(held[at[:, s]] for s in range(n_samples)) / n_samples
        ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * held.shape[1], pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(means.ravel()))

    given = filled(rows, fitted.plan, fitted.fills).withColumn("__given", F.array(*[col(c).cast("string") for c in features]))
    told = with_terms(given, fitted, ["__given"]).withColumn("means", mean_terms(places))
    baseline = F.lit(float(fitted.stages.stages[-1].intercept))
    for i in range(len(features)):
        baseline = baseline + F.col("means")[i]
    listed = [
        F.struct(F.lit(c).alias("feature"), F.col("__given")[i].alias("value"), (F.col(f"t{i}") - F.col("means")[i]).alias("contribution"))
        for i, c in enumerate(features)
    ]
    return told.select("row", F.inline(F.array(*listed)), "prediction", baseline.alias("baseline"))


def is_linear(fitted: FittedModel) -> bool:
    return isinstance(fitted.stages.stages[-1], LinearRegressionModel)


def with_terms(frame: DataFrame, fitted: FittedModel, keep: list[str] | None = None) -> DataFrame:
    """(row, prediction, keep, t0, t1, ..): the term of each feature in a linear regression; a feature that it left out has none.

    Terms are expressions of the row's own columns, so no vector is built.
    """
    keep, model = keep or [], fitted.stages.stages[-1]
    terms = linear_terms(fitted)
    prediction = F.lit(float(model.intercept))
    for i in range(len(terms)):
        prediction = prediction + F.col(f"t{i}")
    told = filled(frame, fitted.plan, fitted.fills).select("row", *keep, *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    return told.select("row", prediction.alias("prediction"), *keep, *[f"t{i}" for i in range(len(terms))])


def linear_terms(fitted: FittedModel) -> list[Column]:
    """The term of each feature of the plan, from columns whose gaps are filled."""
    weights, at, terms = fitted.stages.stages[-1].coefficients.toArray().tolist(), 0, {}
    numbers = []
    labels = []
    for stage in fitted.stages.stages:
        if isinstance(stage, StringIndexerModel):
            labels = list(zip(fitted.plan.categorical, stage.labelsArray))  # the bucket of unseen labels has no place
        elif isinstance(stage, VectorAssembler) and stage.getOutputCol() == "__numbers":
            numbers = [(c, 0.0, 1.0) for c in stage.getInputCols()]
        elif isinstance(stage, StandardScalerModel):
            numbers = [(c, mean, std) for (c, _, _), mean, std in zip(numbers, stage.mean.toArray().tolist(), stage.std.toArray().tolist())]
    for c, known in labels:
        own = dict(zip(known, weights[at : at + len(known)]))
        at += len(known)
        if own:
            terms[c] = F.coalesce(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[col(c)], F.lit(0.0))
    for (c, mean, std), weight in zip(numbers, weights[at:]):
        terms[c] = (col(c) - F.lit(mean)) * F.lit(weight / std if std else 0.0)
    return [terms.get(c, F.lit(0.0)) for c in fitted.plan.features]


def feature_places(fitted: FittedModel) -> dict[str, tuple[int, int]]:
    """First place and number of places of each feature in the vectors that a model sees."""
    places: dict[str, tuple[int, int]] = {}
    at = 0
    for stage in fitted.stages.stages:
        if isinstance(stage, OneHotEncoderModel):
            # the bucket of unseen labels has no place
            widths = zip(fitted.plan.categorical, (n - 1 for n in stage.categorySizes))
        elif isinstance(stage, VectorAssembler) and stage.getOutputCol() == "__numbers":
            widths = ((c, 1) for c in stage.getInputCols())
        else:
            continue
        for feature, width in widths:
            places[feature] = (at, width)
            at += width
    return places


def linear_contributions(experiment: Experiment, fitted: FittedModel, rows: DataFrame | None = None) -> DataFrame:
    """(row, feature, value, contribution, prediction, baseline) of a linear regression, exact.

    In a sum of terms the Shapley value of a feature is its term less the term's mean over the reference
    rows, whatever the order of the features. All rows are the reference here, so nothing is sampled: one aggregate finds the means
    and one pass the contributions. A feature that the model left out contributes nothing.
    """
    if not is_linear(fitted):
        raise ValueError("only a linear regression is a sum of one term for each feature")
    model, features = fitted.stages.stages[-1], experiment.plan.features
    rows = experiment.frame if rows is None else rows
    given = rows.withColumn("__given", F.array(*[col(c).cast("string") for c in features]))
    means = with_terms(experiment.frame, fitted).agg(*[F.avg(f"t{i}").alias(f"m{i}") for i in range(len(features))]).first()
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col("__given")[i].alias("value"), (F.col(f"t{i}") - F.lit(means[i])).alias("contribution"))
            for i, c in enumerate(features)
        ]
    )
    baseline = F.lit(float(model.intercept + sum(means)))
    return with_terms(given, fitted, ["__given"]).select("row", F.inline(listed), "prediction", baseline.alias("baseline"))


def described(contributions: DataFrame) -> DataFrame:
    """Direction of each contribution and its place within its row, largest first."""
    order = Window.partitionBy("row").orderBy(F.desc(F.abs("contribution")), "feature")
    effect = F.col("contribution")
    return contributions.withColumn(
        "direction", F.when(effect > 0.0001, "increases").when(effect < -0.0001, "decreases").otherwise("no effect")
    ).withColumn("place", F.row_number().over(order))


def typical_values(frame: DataFrame, numeric: list[str], labels: list[str]) -> dict[str, float | str | None]:
    """Median of numbers, most frequent label (ties to the smallest)."""
    found: dict[str, float | str | None] = {}
    if numeric:
        found |= {c: v[0] for c, v in exact_quantiles(frame, {c: [0.5] for c in numeric}).items()}
    if labels:
        leaders = spell_out(frame, leading_values(value_counts(frame, labels, "label"), 1), labels).collect()
        found |= {r["column"]: r["value"] for r in leaders}
    return found


def occlusion_contributions(experiment: Experiment, fitted: FittedModel, rows: DataFrame | None = None) -> DataFrame:
    """(row, feature, contribution, prediction, baseline): effect of making one value typical.

    Each row is unfolded into itself, an all-typical row and one variant per feature, and all
    variants are scored in one job. In a linear regression the effect is the row's term less that of the typical value, so rows stay whole.
    """
    plan = experiment.plan
    rows = experiment.frame if rows is None else rows
    positive = _positive(experiment)
    typical = typical_values(experiment.frame, plan.numeric, plan.categorical)
    kinds = {**{c: "double" for c in plan.numeric}, **{c: "string" for c in plan.categorical}}

    def usual(c: str) -> Column:
        return F.lit(typical.get(c)).cast(kinds[c])

    if is_linear(fitted):
        own = rows.sparkSession.range(1).select(F.col("id").alias("row"), *[usual(c).alias(c) for c in plan.features])
        base = with_terms(own, fitted).first()
        listed = F.array(
            *[
                F.struct(F.lit(c).alias("feature"), (F.col(f"t{i}") - F.lit(base[f"t{i}"])).alias("contribution"))
                for i, c in enumerate(plan.features)
            ]
        )
        return with_terms(rows, fitted).select("row", "prediction", F.lit(base["prediction"]).alias("baseline"), F.inline(listed))

    def variant(name: str, replaced: list[str]) -> Column:
        return F.struct(
            F.lit(name).alias("variant"), *[(usual(c) if c in replaced else col(c)).alias(c) for c in plan.features]
        )

    variants = [variant("own value", []), variant("all typical", plan.features)]
    variants += [variant(f"without {c}", [c]) for c in plan.features]
    scored = fitted.predict(rows.select("row", "label", F.inline(F.array(*variants)))).select(
        "row", "variant", prediction_number(fitted, positive).alias("number")
    )

    def of(name: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.col("number")))

    wide = scored.groupBy("row").agg(
        of("own value").alias("prediction"), of("all typical").alias("baseline"),
        *[of(f"without {c}").alias(f"p{i}") for i, c in enumerate(plan.features)],
    )
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.col("prediction") - F.col(f"p{i}")).alias("contribution"))
            for i, c in enumerate(plan.features)
        ]
    )
    return wide.select("row", "prediction", "baseline", F.inline(listed))
