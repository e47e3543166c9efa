"""Linear regressions from moments against Spark ML on the rows, and their explanations against scoring every changed row."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import explanation, modelling
from tablewright.operators.least_squares import Moments, joined, moments_by, plane_points
from tablewright.operators.modelling import Plan, Settings, fold_encodings, fold_predictions, line_predictions, prepared_folds, run_experiment

PLAN = Plan("y", "regression", ["a", "b", "none"], ["c", "d"], [], "rmse", [])
GAPS = {"a", "none", "c", "d"}


@pytest.fixture(scope="module")
def folded(spark):
    rows = [
        (
            i, i % 3, float((i * i) % 29 + 1e6), None if i % 7 == 0 else 5e4 + float(i * i % 11), float(i % 4) / 100, None,
            None if i % 5 == 0 else "xyz"[i * i % 3], "rare" if i == 4 else "é",
        )
        for i in range(90)
    ]
    return spark.createDataFrame(rows, "row long, fold int, label double, a double, b double, none double, c string, d string").repartition(5)


def test_moments_of_groups_are_those_of_their_rows(folded):
    given = {"c": (F.col("c"), ["x", "y", "z"])}
    found = moments_by(folded, F.col("fold"), given, [F.col("b"), F.col("label") * 1e3], F.col("label"))
    rows = folded.collect()
    for fold in range(3):
        own = np.array([[r["c"] == "x", r["c"] == "y", r["c"] == "z", r["b"], r["label"] * 1e3, r["label"]] for r in rows if r["fold"] == fold], float)
        assert found[fold].n == 30 and np.allclose(found[fold].means, own.mean(axis=0), rtol=1e-12)
        assert np.allclose(found[fold].products, 30 * np.cov(own.T, bias=True), rtol=1e-9, atol=1e-6)
    every = np.array([r["b"] for r in rows])
    assert joined(list(found.values())).products[3, 3] == pytest.approx(((every - every.mean()) ** 2).sum())


def test_points_have_the_fit_of_the_rows():
    """Also where places add up to one or are constant, and of very different size."""
    rng = np.random.default_rng(7)
    flag = rng.random(400) < 0.3
    x = np.column_stack([flag, ~flag, rng.normal(5e4, 2e4, 400), rng.normal(0.04, 0.01, 400), np.full(400, 3.5)])
    y = 7 * flag + 0.9 * x[:, 2] - 3e4 * x[:, 3] + rng.normal(size=400)
    both = np.column_stack([x, y])
    points = plane_points(Moments(400, both.mean(axis=0), 400 * np.cov(both.T, bias=True)))
    line, *_ = np.linalg.lstsq(np.column_stack([points[:, :-1] - x.mean(axis=0), np.ones(len(points))]), points[:, -1], rcond=None)
    wanted, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(400)]), y, rcond=None)
    assert np.allclose((x - x.mean(axis=0)) @ line[:-1] + line[-1], np.column_stack([x, np.ones(400)]) @ wanted, rtol=0, atol=1e-6)


def test_folds_predict_like_fits_on_their_rows(folded):
    found = {r["row"]: r for r in line_predictions(folded, PLAN, 3, GAPS, fold_encodings(folded, PLAN, 3, GAPS)).collect()}
    assert len(found) == 90
    for i, vectors in enumerate(prepared_folds(folded, PLAN, 3, [], GAPS)):
        rows = vectors.select("row", "fold", "target", F.concat(vector_to_array("flags"), vector_to_array("numbers")).alias("x")).collect()
        x, y = np.array([r["x"] for r in rows]), np.array([r["target"] for r in rows])
        held = np.array([r["fold"] == i for r in rows])
        centre, middle = x[~held].mean(axis=0), y[~held].mean()
        line, *_ = np.linalg.lstsq((x - centre)[~held] / (x[~held].std(axis=0) + 1e-9), y[~held] - middle, rcond=1e-10)
        wanted = (x - centre) / (x[~held].std(axis=0) + 1e-9) @ line + middle
        seen = (x[~held].std(axis=0) > 0) | ((x[held] if held.any() else x) == centre).all(axis=0)
        for r, w in zip(rows, wanted):
            if r["fold"] == i and ((np.array(r["x"]) == centre) | seen).all():
                own = found[r["row"]]
                assert (own["fold"], own["label"], own["scores"]) == (i, r["target"], None)
                assert own["prediction"] == pytest.approx(w, abs=1e-6)
        # the fit on rows ends near the same plane, by steps
        for r in fold_predictions("linear_regression", vectors, i, PLAN, [], Settings()).collect():
            assert found[r["row"]]["prediction"] == pytest.approx(r["prediction"], abs=0.05)


def test_an_experiment_with_a_line_alone_writes_no_vectors(folded, monkeypatch):
    def unwanted(*args, **given):
        raise AssertionError("a linear regression needs no vectors of rows")

    monkeypatch.setattr(modelling, "prepared_folds", unwanted)
    plan = Plan(**{**PLAN.__dict__, "target": "label", "candidates": [modelling.Candidate("linear_regression", 1, True)], "other_metrics": ["r2"]})
    result = run_experiment(folded, "label", plan=plan)
    assert not result.failures and result.predictions["linear_regression"].count() == 90
    assert result.scores.where("value is not null").count() == 10


def test_wide_designs_are_fitted_on_their_rows(folded, monkeypatch):
    """Beyond the places that a task sums up, passes over the rows give the same line."""
    monkeypatch.setattr(modelling, "MOST_PLACES", 2)
    wide = modelling.fit_model("linear_regression", folded, PLAN, [], GAPS)
    monkeypatch.undo()
    line = modelling.fit_model("linear_regression", folded, PLAN, [], GAPS)
    both = [{r["row"]: r["prediction"] for r in m.predict(folded).collect()} for m in (wide, line)]
    assert both[0].keys() == both[1].keys()
    for k, v in both[0].items():
        assert both[1][k] == pytest.approx(v, abs=0.05)


def test_typical_values_by_terms_and_by_changed_rows(folded, monkeypatch):
    experiment = modelling.Experiment(PLAN, folded, [], GAPS, 3, None)
    line = explanation.refit(experiment, "linear_regression")

    def found():
        return {(r["row"], r["feature"]): r.asDict() for r in explanation.occlusion_contributions(experiment, line).collect()}

    plan = explanation.occlusion_contributions(experiment, line)._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan  # rows stay where they are
    terms = found()
    monkeypatch.setattr(explanation, "is_linear", lambda fitted: False)
    walked = found()
    assert terms.keys() == walked.keys() and len(terms) == 90 * 5
    for k, r in walked.items():
        for name in ("contribution", "prediction", "baseline"):
            assert terms[k][name] == pytest.approx(r[name], abs=1e-6)


def test_shuffled_terms_by_columns_and_by_changed_rows(folded, monkeypatch):
    experiment = modelling.Experiment(PLAN, folded, [], GAPS, 3, None)
    line = explanation.refit(experiment, "linear_regression")

    def unwanted(*args):
        raise AssertionError("terms need no changed rows")

    with monkeypatch.context() as patched:
        patched.setattr(explanation, "_shuffled_variants", unwanted)
        patched.setattr(explanation, "_group_score", unwanted)  # one unfolded row for each feature
        terms = {r["feature"]: r for r in explanation.permutation_importance(experiment, line, repeats=3).collect()}
    monkeypatch.setattr(explanation, "is_linear", lambda fitted: False)
    walked = {r["feature"]: r for r in explanation.permutation_importance(experiment, line, repeats=3).collect()}
    assert terms.keys() == walked.keys() == set(PLAN.features)
    for k, r in walked.items():
        for name in ("importance", "std", "share"):
            assert terms[k][name] == pytest.approx(r[name], abs=1e-6)


def test_terms_are_expressions_and_no_vectors(folded):
    experiment = modelling.Experiment(PLAN, folded, [], GAPS, 3, None)
    line = explanation.refit(experiment, "linear_regression")
    told = explanation.with_terms(folded, line)
    assert "UDF" not in told._jdf.queryExecution().toString()
    given = {r["row"]: r["prediction"] for r in line.predict(folded).collect()}
    for r in told.collect():
        assert r["prediction"] == pytest.approx(given[r["row"]], abs=1e-6)
        assert r["t2"] == 0.0  # nothing fills `none`
