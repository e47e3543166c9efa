"""Shapley steps through the cells of trees against scoring every step."""

import math

import pytest
from pyspark.sql import functions as F

from tablewright.operators import explanation, modelling
from tablewright.operators.modelling import Settings

SMALL = Settings(max_depth=6, n_trees=12, boosting_rounds=4)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (
            i, str((i * i % 17 + i % 5 > 9) + (i % 23 > 18)), None if i % 11 == 0 else float(i * i % 37), float(i * 7 % 23) / 3,
            None if i % 13 == 0 else "xyz"[i * i % 3],
        )
        for i in range(240)
    ]
    return spark.createDataFrame(rows, "row long, label string, a double, b double, c string").repartition(3).cache()


@pytest.mark.parametrize("model, kind", [
    ("random_forest", "multiclass_classification"), ("decision_tree", "binary_classification"), ("gradient_boosting", "binary_classification"),
    ("random_forest", "regression"),
])
def test_cells_give_what_the_walk_gives(frame, monkeypatch, model, kind):
    if kind == "regression":
        df, classes = frame.withColumn("label", F.col("label").cast("double") * 3 + F.coalesce("a", F.lit(5.0))), []
    elif kind == "binary_classification":
        df, classes = frame.withColumn("label", F.when(F.col("label") == "2", "1").otherwise(F.col("label"))), ["0", "1"]
    else:
        df, classes = frame, ["0", "1", "2"]
    plan = modelling.Plan("label", kind, ["a", "b"], ["c"], [], "accuracy", [])
    experiment = modelling.Experiment(plan, df, classes, {"a", "c"}, 3, None, settings=SMALL)
    fitted = explanation.refit(experiment, model)
    # rows with an unknown label, values at a threshold, beyond all and missing
    cells = explanation.tree_cells(fitted, F.col("prediction"))
    assert cells is not None and len(cells.scores) < 10_000
    odd = df.sparkSession.createDataFrame(
        [(1000, "0", -1e9, 7 / 3, "new"), (1001, "1", 1e9, math.inf, None), (1002, "1", 5.0, 0.0, "x"), (1003, "0", None, 22 / 3, "z")], df.select("row", "label", "a", "b", "c").schema
        if kind != "regression" else "row long, label string, a double, b double, c string",
    ).withColumn("label", F.col("label").cast(dict(df.dtypes)["label"]))
    rows = df.select("row", "label", "a", "b", "c").unionByName(odd)

    def found():
        return {(r["row"], r["feature"]): r.asDict() for r in explanation.shapley_contributions(experiment, fitted, rows, n_samples=9, n_background=25).collect()}

    def unwanted(*args):
        raise AssertionError("steps are looked up")

    with monkeypatch.context() as patched:
        patched.setattr(explanation, "_sampled_linear_contributions", unwanted)
        looked_up = found()
    monkeypatch.setattr(explanation, "MOST_CELLS", 1)
    assert explanation.tree_cells(fitted, F.col("prediction")) is None
    walked = found()
    assert looked_up.keys() == walked.keys() and len(walked) == 244 * 3
    assert len({round(r["contribution"], 6) for r in walked.values()}) > 10
    for k, r in walked.items():
        for name, v in r.items():
            assert looked_up[k][name] == (pytest.approx(v, abs=1e-9) if isinstance(v, float) else v)
