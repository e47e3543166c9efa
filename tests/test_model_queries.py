import pytest

from checks import REGISTRY, model_queries
from tablewright.operators import modelling


class Reached(Exception):
    pass


@pytest.mark.parametrize(
    "name", ["model_comparison", "held_out_confusion", "shapley_contributions", "scorecard_with_model", "cross_validated_regression"]
)
def test_model_queries_train_all_candidates_with_the_defaults(spark, monkeypatch, name):
    runs = []

    def run(df, target, **given):
        runs.append(given)
        raise Reached

    monkeypatch.setattr(modelling, "run_experiment", run)
    for _ in range(2):  # nothing is shared between queries
        with pytest.raises(Reached):
            REGISTRY[name][0](spark, "/root/testdata/sf0.001")
    assert len(runs) == 2
    for given in runs:
        assert given.get("settings", modelling.Settings()) == modelling.Settings()
        assert given.get("plan") is None and given.get("models") is None


def test_contributions_are_drawn_as_often_as_by_default(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(model_queries, "fitted", lambda *a: (None, None))

    def contributions(*args, **given):
        calls.append(given)
        raise Reached

    monkeypatch.setattr(model_queries.explanation, "shapley_contributions", contributions)
    with pytest.raises(Reached):
        REGISTRY["shapley_adds_up"][0](spark, "/root/testdata/sf0.001")
    assert calls == [{}]


def test_the_quality_frame_reads_the_texts_once(spark):
    folder = "/root/testdata/sf0.001"
    frame = model_queries.quality_frame(spark, folder)
    assert not [f for f in frame.inputFiles() if "documents" in f or "labels" in f]
    labels, documents = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "documents"))
    known = {r["doc_id"]: (r["lang"], r["n_chars"], r["text"].count(" ")) for r in documents.where("text IS NOT NULL").collect()}
    wanted = [(r["quality"], r["toxic"], *known[r["doc_id"]]) for r in labels.collect() if r["doc_id"] in known]
    got = [(r["quality"], r["toxic"], r["lang"], r["n_chars"], r["n_spaces"]) for r in frame.where("n_spaces IS NOT NULL").collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))


def test_a_model_that_failed_is_no_row_less(spark, monkeypatch):
    """A query names the model that failed; without the check its rows would be those of an experiment without it."""
    df = spark.createDataFrame([(i * 1.37 + i % 3, i * i % 37 + 0.5, i % 41 + 0.25) for i in range(80)], "net double, a double, b double")
    real = modelling.estimator

    def broken(model, *rest):
        if model in failing:
            raise RuntimeError("no trees today")
        return real(model, *rest)

    monkeypatch.setattr(modelling, "estimator", broken)
    monkeypatch.setattr(model_queries, "PLANTED", type("Given", (), {"read": staticmethod(lambda *a: df)}))
    failing = ["random_forest"]
    with pytest.raises(RuntimeError, match="random_forest: no trees today"):
        model_queries.price_experiment(spark, "", ["linear_regression", "random_forest"])
    assert modelling.run_experiment(df, "net", models=["linear_regression", "random_forest"]).failures.keys() == {"random_forest"}
    with pytest.raises(RuntimeError, match="no trees today"):  # nothing was fitted, so there is no empty result either
        modelling.run_experiment(df, "net", models=["random_forest"])


def test_a_failed_job_is_raised_where_all_are_needed(spark):
    done = []
    with pytest.raises(ZeroDivisionError):
        modelling.all_together(spark, [lambda: 1 / 0, lambda: done.append(spark.range(5).count())], 2)
    assert done == [5]
