import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import explanation, modelling
from tablewright.operators.modelling import Settings, run_experiment
from tablewright.operators.ordering import positions_within
from tablewright.operators.profile import Profile
from tablewright.session import cut_lineage

SMALL = Settings(max_depth=5, n_trees=10, boosting_rounds=5)


@pytest.fixture(scope="module")
def classified(spark):
    """Made-up seeds: whether one sprouts follows from warmth and, less, from depth; the tray says nothing."""
    rng = np.random.default_rng(1234)
    n = 270
    warmth, depth = rng.uniform(4, 24, n), rng.uniform(0.2, 6, n)
    sprouts = np.where(0.3 * (warmth - 14) - 0.8 * (depth - 3) + rng.logistic(scale=0.35, size=n) > 0, "sprouts", "rots")
    data = pd.DataFrame({"warmth": warmth, "depth": depth, "tray": rng.choice(["oak", "tin", "clay", "cork"], n), "fate": sprouts})
    data.loc[data.index % 13 == 0, "depth"] = np.nan
    data.loc[data.index % 29 == 0, "tray"] = None
    return spark.createDataFrame(data)


@pytest.fixture(scope="module")
def experiment(classified):
    return run_experiment(classified, "fate", settings=SMALL, models=["logistic_regression", "decision_tree"])


@pytest.fixture(scope="module")
def explained(experiment):
    return explanation.refit(experiment, "logistic_regression")


def test_problem_types(frame):
    df = frame(b=[0, 1] * 20, c=[0.5 * i for i in range(40)], m=["a", "b", "c", "d"] * 10, d=[i % 5 for i in range(40)], e=[i % 17 for i in range(40)], k=["z"] * 40)
    kinds = {r["column"]: r["problem_type"] for r in modelling.problem_types(Profile.of(df).frame).collect()}
    assert kinds == {
        "b": "binary_classification", "c": "regression", "m": "multiclass_classification", "d": "multiclass_classification",
        "e": "regression", "k": "unknown",
    }


def test_identifiers_are_left_out_and_boosting_needs_rows(spark):
    rng = np.random.default_rng(9)
    for n, expected in ((260, 3), (640, 4)):
        df = spark.createDataFrame(
            pd.DataFrame({"hive": [f"H{k:05d}" for k in range(n)], "kilos": rng.gamma(3, 4, n), "slope": rng.choice(["n", "s", "e", "w"], n), "swarmed": rng.random(n) < 0.4})
        )
        plan = modelling.modelling_plan(df, "swarmed")
        assert "hive" not in plan.features and len(plan.candidates) == expected
        assert plan.numeric == ["kilos"] and plan.categorical == ["slope"]


def test_imbalance_switches_the_metric(frame):
    df = frame(weight=[0.3 * k for k in range(220)], broken=["no"] * 207 + ["yes"] * 13)
    assert modelling.modelling_plan(df, "broken").primary_metric == "f1"
    warnings = {r["warning"] for r in modelling.data_warnings(Profile.of(df).frame, "broken").collect()}
    assert warnings == {"severe_imbalance"}


def test_long_labels_fill_gaps_in_full(spark):
    long = "a label of many words " * 8
    df = spark.createDataFrame([(long, float(k), "yn"[k % 2]) for k in range(20)] + [(None, 1.5, "y"), ("b", 2.5, "n")], "c string, x double, t string")
    plan = modelling.modelling_plan(df, "t")
    assert modelling.gap_fills(df, modelling.Plan(**{**plan.__dict__, "categorical": ["c"]}), {"c"}) == {"c": long}
    assert explanation.typical_values(df, ["x"], ["c"])["c"] == long


def test_warnings_of_a_tiny_table(spark):
    df = spark.createDataFrame([(0.5 * i, 1.5 * i, float(i) if i % 3 else None) for i in range(12)], "a double, b double, t double")
    warnings = {r["warning"] for r in modelling.data_warnings(Profile.of(df).frame, "t").collect()}
    assert warnings == {"very_few_rows", "many_features", "target_gaps"}


def test_folds_are_stratified_to_the_row(classified, experiment):
    sizes = experiment.frame.groupBy("label", "fold").count().collect()
    for label in {r["label"] for r in sizes}:
        counts = [r["count"] for r in sizes if r["label"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_positions_with_many_buckets_are_dense(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise("cold"))
    placed = positions_within(df, ["g"], F.xxhash64("id"), 1000, rows_per_bucket=50)
    for g, n in (("hot", 700), ("cold", 300)):
        found = sorted(r["position"] for r in placed.where(F.col("g") == g).collect())
        assert found == list(range(n))
    assert sorted(r["position"] for r in positions_within(df, [], F.xxhash64("id"), 1000, rows_per_bucket=50).collect()) == list(range(1000))


def test_folds_shrink_to_the_rarest_class(frame):
    df = frame(label=["a"] * 20 + ["b"] * 3, x=[float(i) / 3 for i in range(23)])
    plan = modelling.modelling_plan(df, "label")
    assert modelling.usable_folds(modelling.model_frame(df, plan), plan) == 3


def test_models_learn_the_signal(experiment):
    assert not experiment.failures
    summary = {(r["model"], r["metric"]): r for r in modelling.score_summary(experiment.scores).collect()}
    assert summary["logistic_regression", "accuracy"]["mean"] > 0.75
    assert summary["logistic_regression", "roc_auc"]["mean"] > 0.85
    assert all(r["n_folds"] == 5 for r in summary.values())
    best = modelling.best_model(modelling.score_summary(experiment.scores), "accuracy").first()
    assert best["score"] == max(r["mean"] for (m, k), r in summary.items() if k == "accuracy")


def test_regression_and_failing_model(spark, monkeypatch):
    rng = np.random.default_rng(64)
    span, piers = rng.uniform(10, 80, 240), rng.integers(1, 9, 240) + 0.0
    df = spark.createDataFrame(pd.DataFrame({"span": span, "piers": piers, "tonnes": 12 + 0.4 * span + 3 * piers + rng.normal(scale=1.1, size=240)}))
    real = modelling.estimator

    def broken(model, *rest):
        if model == "decision_tree":
            raise RuntimeError("no trees today")
        return real(model, *rest)

    monkeypatch.setattr(modelling, "estimator", broken)
    result = run_experiment(df, "tonnes", settings=SMALL, models=["linear_regression", "decision_tree"])
    assert "no trees today" in result.failures["decision_tree"]
    summary = {r["metric"]: r["mean"] for r in modelling.score_summary(result.scores).collect()}
    assert summary["r2"] > 0.8 and summary["rmse"] < 2


def test_unusable_target_is_an_error(frame):
    with pytest.raises(ValueError):
        run_experiment(frame(x=[1.5, 2.5, 3.5], k=["z"] * 3), "k")


def test_fills_come_from_the_rows_given(frame):
    plan = modelling.Plan("y", "regression", ["x"], ["c"], [], "rmse", [])
    df = frame(x=[1.0, 2.0, 10.0, 20.0, None], c=["b", "b", "a", "a", None])
    assert modelling.gap_fills(df, plan, {"x", "c"}) == {"x": 6.0, "c": "a"}


def test_unseen_labels_become_zeros(frame, spark):
    plan = modelling.Plan("y", "regression", [], ["c"], [], "rmse", [])
    train = frame(c=["a", "a", "b", "b"] * 5, label=[1.0, 1.0, 3.0, 3.0] * 5)
    fitted = modelling.fit_model("linear_regression", train, plan, [], set())
    coded = fitted.stages.transform(spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string"))
    flags = [(r["c"], r["features"].toArray().tolist()) for r in coded.collect()]
    assert flags == [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("new", [0.0, 0.0]), (None, [0.0, 0.0])]


def test_three_classes_and_boosting(spark):
    rng = np.random.default_rng(9)
    n = 300
    driver = rng.normal(size=n)
    grade = np.where(driver < -0.5, "low", np.where(driver < 0.5, "mid", "high"))
    df = spark.createDataFrame(pd.DataFrame({"driver": driver, "junk": rng.normal(size=n), "grade": grade}))
    plan = modelling.Plan("grade", "multiclass_classification", ["driver", "junk"], [], [modelling.Candidate("gradient_boosting", 1)], "accuracy", ["roc_auc"], 3)
    result = run_experiment(df, "grade", plan=plan, settings=Settings(boosting_rounds=3))
    assert not result.failures
    summary = {r["metric"]: r["mean"] for r in modelling.score_summary(result.scores).collect()}
    assert summary["accuracy"] > 0.8 and summary["roc_auc"] > 0.8
    cells = explanation.confusion_cells(result.predictions["gradient_boosting"], result.classes).collect()
    assert len(cells) == 9 and sum(r["n"] for r in cells) == n


# ---- explanations ----------------------------------------------------------------------------


def test_signal_ranks_above_noise(experiment, explained):
    rows = explanation.permutation_importance(experiment, explained).collect()
    assert rows[0]["feature"] == "warmth" and rows[0]["importance"] > 0.05
    assert sum(r["share"] for r in rows) == pytest.approx(1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_shuffle_uses_every_value_once(spark, monkeypatch):
    monkeypatch.setattr(explanation, "SHUFFLE_BUCKET_ROWS", 40)
    frame = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * 2).alias("v"))
    rows = explanation.shuffled_donors(frame, ["v"], 500, 2, 1).collect()
    for repeat in (0, 1):
        own = [r for r in rows if r["repeat"] == repeat]
        assert sorted(r["donor"]["v"] for r in own) == sorted(r["v"] for r in own)
        assert sum(r["donor"]["v"] == r["v"] for r in own) < 50


def test_shapley_adds_up(experiment, explained):
    rows = explanation.shapley_contributions(experiment, explained, explanation.example_rows(experiment, 4), n_samples=15).collect()
    assert len(rows) == 4 * 3
    for row in {r["row"] for r in rows}:
        own = [r for r in rows if r["row"] == row]
        assert sum(r["contribution"] for r in own) == pytest.approx(own[0]["prediction"] - own[0]["baseline"], abs=1e-9)
        assert 0 <= own[0]["prediction"] <= 1


@pytest.fixture(scope="module")
def sprouting_heat(classified):
    """A regression with a gap and a column of labels."""
    plan = modelling.Plan("warmth", "regression", ["depth"], ["tray", "fate"], [], "rmse", [])
    frame = cut_lineage(modelling.model_frame(classified, plan))
    experiment = modelling.Experiment(plan, frame, [], {"depth", "tray"}, 5, None)
    return experiment, explanation.refit(experiment, "linear_regression")


def test_linear_contributions_equal_the_mean_over_all_references(sprouting_heat):
    experiment, line = sprouting_heat
    rows = explanation.example_rows(experiment, 3)
    found = {(r["row"], r["feature"]): r for r in explanation.linear_contributions(experiment, line, rows).collect()}
    assert len(found) == 3 * 3
    reference = experiment.frame.select(*[F.col(c).alias(f"r_{c}") for c in experiment.plan.features])
    paired = rows.crossJoin(reference)
    base = line.predict(experiment.frame).agg(F.avg("prediction")).first()[0]
    for feature in experiment.plan.features:
        swapped = paired.select("row", "label", *[F.col(c if c == feature else f"r_{c}").alias(c) for c in experiment.plan.features])
        for r in line.predict(swapped).groupBy("row").agg(F.avg("prediction").alias("mean")).collect():
            own = found[r["row"], feature]
            assert own["contribution"] == pytest.approx(r["mean"] - base, abs=1e-9)
            assert own["baseline"] == pytest.approx(base, abs=1e-9)
    for row in {k[0] for k in found}:
        own = [r for (k, _), r in found.items() if k == row]
        assert sum(r["contribution"] for r in own) == pytest.approx(own[0]["prediction"] - own[0]["baseline"], abs=1e-9)


def test_sampled_contributions_come_close_to_the_exact_ones(sprouting_heat):
    experiment, line = sprouting_heat
    rows = cut_lineage(explanation.example_rows(experiment, 4))
    exact = {(r["row"], r["feature"]): r["contribution"] for r in explanation.linear_contributions(experiment, line, rows).collect()}
    spread = {}
    for r in explanation.linear_contributions(experiment, line).collect():
        spread.setdefault(r["feature"], []).append(r["contribution"])
    n = 200
    for r in explanation.shapley_contributions(experiment, line, rows, n_samples=n, n_background=270).collect():
        # five standard errors of a mean over drawn references
        assert abs(r["contribution"] - exact[r["row"], r["feature"]]) <= 5 * np.std(spread[r["feature"]]) / n**0.5 + 1e-9


def test_terms_give_what_the_walk_through_the_model_gives(sprouting_heat, monkeypatch):
    """The short ways of a linear regression against scoring every changed row."""
    experiment, line = sprouting_heat

    def both():
        steps = explanation.shapley_contributions(experiment, line, n_samples=7, n_background=20).collect()
        drops = explanation.permutation_importance(experiment, line).collect()
        return {(r["row"], r["feature"]): r for r in steps}, {r["feature"]: r for r in drops}

    short = both()
    monkeypatch.setattr(explanation, "is_linear", lambda fitted: False)
    for ours, walked in zip(short, both()):
        assert ours.keys() == walked.keys()
        for k, r in walked.items():
            for name, v in r.asDict().items():
                assert ours[k][name] == (pytest.approx(v, abs=1e-8) if isinstance(v, float) else v)


def test_trees_are_no_sum_of_terms(experiment, explained):
    with pytest.raises(ValueError):
        explanation.linear_contributions(experiment, explained)


def test_from_target_to_explanation_in_one_call(experiment, classified):
    from tablewright.plans.analyses import dataset_scorecard, explain_target

    found = explain_target(classified, "fate", experiment=experiment, rows=explanation.example_rows(experiment, 2))
    assert found.model in experiment.predictions and found.importance.first()["feature"] in ("warmth", "depth")
    assert found.contributions.count() == 2 * 3 and found.outcomes.first()["n"] == 270
    card = dataset_scorecard(classified, "fate", experiment=experiment).first()
    assert card["best_model"] == found.model


def test_contributions_are_described(spark):
    given = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.7), (1, "c", 0.00005)], "row int, feature string, contribution double")
    rows = {r["feature"]: (r["direction"], r["place"]) for r in explanation.described(given).collect()}
    assert rows == {"a": ("increases", 2), "b": ("decreases", 1), "c": ("no effect", 3)}


def test_occlusion_of_a_typical_value_is_zero(experiment, explained):
    rows = explanation.occlusion_contributions(experiment, explained).collect()
    assert {r["feature"] for r in rows} == {"warmth", "depth", "tray"}
    assert all(abs(r["contribution"]) <= 1 for r in rows)


def test_confusion_and_positive_class(experiment):
    cells = explanation.confusion_cells(experiment.predictions["logistic_regression"], experiment.classes)
    positive = explanation.positive_class(explanation.label_counts(experiment.frame)).first()["positive_class"]
    out = explanation.binary_outcomes(cells, positive).first()
    assert out["n"] == 270 and out["accuracy"] > 0.75
    assert out["true_negative"] + out["false_positive"] + out["false_negative"] + out["true_positive"] == 270


def test_positive_class_rules(spark):
    def of(rows):
        return explanation.positive_class(spark.createDataFrame(rows, "label string, n bigint")).first()[0]

    assert of([("no", 90), ("yes", 10)]) == "yes"
    assert of([("a", 5), ("b", 9), ("c", 9)]) == "b"
