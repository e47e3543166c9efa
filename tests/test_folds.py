"""Statistics of all folds at once against one fold at a time."""

import math
import time

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import modelling
from tablewright.operators.modelling import Plan, Settings, fold_encodings, fold_predictions, prepared_folds, run_experiment, together
from tablewright.operators.ordering import running_totals

PLAN = Plan("y", "regression", ["a", "b", "none"], ["c", "d"], [], "rmse", [])
GAPS = {"a", "none", "c", "d"}


@pytest.fixture(scope="module")
def folded(spark):
    rows = [
        (i, i % 3, float(i), None if i % 7 == 0 else float(i * i % 11), float(i % 4), None, None if i % 5 == 0 else "xyz"[i % 3], "rare" if i == 4 else "é")
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "row long, fold int, label double, a double, b double, none double, c string, d string").repartition(3)


def test_fills_equal_those_of_each_training_part(folded):
    for i, e in enumerate(fold_encodings(folded, PLAN, 3, GAPS)):
        train = folded.where(F.col("fold") != i)
        assert e.fills == modelling.gap_fills(train, PLAN, GAPS)
        for c in PLAN.categorical:
            assert e.labels[c] == sorted({r[0] for r in train.select(c).collect() if r[0] is not None})


def test_vectors_know_only_labels_of_the_training_part(folded):
    prepared = prepared_folds(folded, PLAN, 3, [], GAPS)
    for i, vectors in enumerate(prepared):
        rows = {r["row"]: r for r in vectors.select("row", vector_to_array("flags").alias("f"), vector_to_array("numbers").alias("n")).collect()}
        assert len(rows) == 60 and all(len(r["n"]) == 2 for r in rows.values())  # nothing fills `none`
        labels = fold_encodings(folded, PLAN, 3, GAPS)[i].labels
        assert all(len(r["f"]) == len(labels["c"]) + len(labels["d"]) for r in rows.values())
        seen = "rare" in labels["d"]
        assert seen == (i != 4 % 3)
        assert sum(rows[4]["f"]) == (2 if seen else 0)  # its other label is in that fold alone, too


def test_folds_with_one_encoding_share_their_vectors(folded):
    """Vectors are written once for folds that learn the same fills and labels, and apart for the others."""
    plan = Plan("y", "regression", ["b"], [], [], "rmse", [])
    assert len({tuple(sorted(v.inputFiles())) for v in prepared_folds(folded, plan, 3, [], set())}) == 1
    assert len({tuple(sorted(v.inputFiles())) for v in prepared_folds(folded, PLAN, 3, [], GAPS)}) > 1


def test_running_totals(spark):
    counts = spark.createDataFrame([(g, v, v, 1) for g in "ab" for v in range(50)], "g string, v int, x int, y int")
    got = {(r["g"], r["v"]): (r["before_x"], r["before_y"]) for r in running_totals(counts, "g", "v", ["x", "y"]).collect()}
    assert got == {(g, v): (v * (v - 1) // 2, v) for g in "ab" for v in range(50)}


def test_jobs_side_by_side_keep_their_order_and_failures(spark):
    jobs = [lambda n=n: spark.range(n).count() if n != 2 else 1 / 0 for n in range(5)]
    out = together(spark, jobs, 3)
    assert [o for o in out if not isinstance(o, Exception)] == [0, 1, 3, 4] and isinstance(out[2], ZeroDivisionError)


def test_a_fold_is_predicted_by_the_others(folded):
    prepared = prepared_folds(folded, PLAN, 3, [], GAPS)
    for i in range(3):
        rows = fold_predictions("decision_tree", prepared[i], i, PLAN, [], Settings(max_depth=5)).collect()
        assert {r["row"] for r in rows} == {k for k in range(60) if k % 3 == i}
        outside = {float(k) for k in range(60) if k % 3 != i}
        assert all(min(outside) <= r["prediction"] <= max(outside) for r in rows)


def test_a_table_is_trained_with_the_defaults(spark, tables):
    """All candidates on a given table, nothing replaced."""
    df = tables("orders").select("o_totalprice", F.length("o_orderpriority").alias("n"), (F.col("o_totalprice") * 2).alias("twice")).limit(600)
    result = run_experiment(df, "o_totalprice", models=["linear_regression", "decision_tree"])
    assert not result.failures
    assert result.scores.groupBy("model", "metric").count().where("count <> 5").count() == 0


def test_few_training_rows_are_not_dealt_to_all_cores(spark, folded):
    vectors = prepared_folds(folded, PLAN, 3, [], GAPS)[0].repartition(6)
    cores = spark.sparkContext.defaultParallelism
    wide = modelling.dealt_for_fit(vectors, "random_forest", PLAN, 60, Settings(rows_per_task=1))
    assert wide.count() == 60 and wide.rdd.getNumPartitions() == cores
    one = modelling.dealt_for_fit(vectors, "random_forest", PLAN, 60, Settings())
    labels = [[r["target"] for r in part] for part in one.rdd.glom().collect()]
    assert labels == [[float(i) for i in range(60)]]


def test_boosting_runs_before_the_long_tasks_of_other_models(spark):
    log = []

    def job(model, i):
        log.append(("start", model))
        time.sleep(0.2)
        log.append(("end", model))
        return model, i

    keys = [(m, i) for m in ("random_forest", "gradient_boosting") for i in range(3)]
    done = modelling.in_phases(spark, {key: lambda key=key: job(*key) for key in keys}, 2)
    assert done == {key: key for key in keys}
    assert [m for _, m in log] == ["gradient_boosting"] * 6 + ["random_forest"] * 6
    assert [what for what, _ in log[:3]] == ["start"] * 3  # all folds of boosting at once


CLASSES = Plan("y", "binary_classification", ["a", "b"], ["c"], [], "accuracy", [])


def _classified(spark, copies=1, n_classes=2):
    rows = [
        (i + 900 * k, i % 3, str((i * i % 17 + i % 5 > 9) + (i % 23 > 18 and n_classes > 2)), float(i * i % 17), float(i * 7 % 23) / 3, "xyz"[i * i % 3])
        for i in range(900) for k in range(copies)
    ]
    return spark.createDataFrame(rows, "row long, fold int, label string, a double, b double, c string").repartition(3)


@pytest.mark.parametrize("model, n_classes", [("decision_tree", 2), ("gradient_boosting", 2), ("decision_tree", 3), ("gradient_boosting", 3)])
def test_groups_of_rows_predict_like_the_rows(spark, model, n_classes):
    """Up to 32 values have a bin each, as in Spark's own splits, so both fits have the same sums to choose from."""
    classes = ["0", "1", "2"][:n_classes]
    prepared = prepared_folds(_classified(spark, n_classes=n_classes), CLASSES, 3, classes, set())
    groups = modelling.grouped_folds(prepared, 3, 32)
    settings = Settings(max_depth=6, boosting_rounds=4)
    rows, grouped = (
        {r["row"]: r for r in fold_predictions(model, prepared[1], 1, CLASSES, classes, settings, g).collect()} for g in (None, groups[1])
    )
    assert rows.keys() == grouped.keys() and len(rows) == 300
    assert len({r["prediction"] for r in rows.values()}) > 1
    for k, r in rows.items():
        assert r["prediction"] == grouped[k]["prediction"] and r["label"] == grouped[k]["label"]
        assert r["scores"] == pytest.approx(grouped[k]["scores"], abs=1e-9)


def test_groups_grow_with_what_differs_and_not_with_rows(spark):
    once, often = (
        modelling.grouped_folds(prepared_folds(_classified(spark, copies), CLASSES, 3, ["0", "1"], set()), 3, 32) for copies in (1, 4)
    )
    for i in range(3):
        assert [g[i].n_train for g in (once, often)] == [600, 2400]
        weights = [
            {(r["target"], str(r["flags"]), str(r["bins"])): r["weight"] for r in g[i].frame.collect()} for g in (once, often)
        ]
        assert {k: 4 * w for k, w in weights[0].items()} == weights[1] and sum(weights[0].values()) == 600


def test_cuts_deal_the_training_part_evenly_and_split_no_value(spark):
    """Against the rows of every fold: few values, many, one that fills a third of the rows, one only, and infinite ones."""
    values = [(i % 3, [float(i % 7), float(i) ** 1.5, -5.0 if i % 3 != i % 9 else i / 7.0, 2.5, [-math.inf, 1.0, math.inf][i % 3 - (i % 5 == 0)]]) for i in range(1200)]
    frame = spark.createDataFrame([(f, v) for f, v in values], "fold int, v array<double>").repartition(4)
    vectors = frame.select("fold", array_to_vector("v").alias("numbers"))
    cuts = modelling.fold_cuts(vectors, 3, 32)
    for i in range(3):
        train = [v for f, v in values if f != i]
        few, many, heavy, one, ends = cuts[i]
        assert few == [k + 0.5 for k in range(6)] and one == [] and all(math.isfinite(c) for c in ends) and len(ends) >= 1
        sizes = [sum(a <= v[1] < b for v in train) for a, b in zip([-math.inf, *many], [*many, math.inf])]
        assert len(many) == 31 and sum(sizes) == 800 and max(sizes) - min(sizes) <= 1
        assert heavy == sorted(set(heavy)) and not {v[2] for v in train} & set(heavy)
    placed = modelling.binned(vectors, cuts[0]).select(vector_to_array("numbers").alias("n"), vector_to_array("bins").alias("b")).collect()
    for r in placed:
        assert r["b"] == [sum(c <= x for c in (own or [0.0])) for own, x in zip(cuts[0], r["n"])]
