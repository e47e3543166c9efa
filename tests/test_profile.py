import datetime as dt
import random

import pandas as pd
import pytest

from tablewright.operators.profile import Profile, column_profile, dataset_profile, observations


def kind(df, column):
    return Profile.of(df).named(column)["semantic_type"]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([10.5, 20.1, 33.3, 47.9, 50.2, 61.7, 72.4], "numeric_continuous"),
        ([0, 1, 2, 0, 1, 3, 2, 1, 0, 2], "numeric_discrete"),
        ([0, 1, 1, 0, 1, 0, 0, 1], "binary"),
        (["red", "blue", "green", "red", "blue", "red"], "categorical"),
        (list(range(1000, 1100)), "identifier"),
        (["x"] * 50, "constant"),
        ([f"this is review number {i} of the product" for i in range(50)], "text"),
        ([f"C{i:03d}" for i in range(30)], "identifier"),
        ([dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(30)], "datetime"),
        ([True, False, None, True], "binary"),
    ],
)
def test_semantic_types(frame, values, expected):
    assert kind(frame(c=values), "c") == expected


def test_all_missing_column_is_constant(spark):
    assert kind(spark.createDataFrame([(None,), (None,)], "c double"), "c") == "constant"


def test_nan_counts_as_missing(frame):
    row = Profile.of(frame(x=[1.0, float("nan"), 3.0, None, 5.0])).named("x")
    assert (row["n_missing"], row["missing_pct"], row["n_unique"]) == (2, 40.0, 3)


def test_statistics_match_hand_values(frame):
    values = [1.5, 2.5, 3.5, 4.5, 10.0]
    row = Profile.of(frame(x=values)).named("x")
    assert (row["min"], row["max"], row["mean"], row["median"]) == (1.5, 10.0, 4.4, 3.5)
    assert (row["q25"], row["q75"]) == (2.5, 4.5)
    assert row["std"] == pytest.approx(pd.Series(values).std(), abs=1e-4)
    assert row["skew"] == pytest.approx(pd.Series(values).skew(), abs=1e-4)


def test_duplicates_treat_gaps_as_equal(frame):
    df = frame(a=[1, 1, 2, 3, 3], b=["x", "x", "y", None, None], c=[float("nan")] * 3 + [None, float("nan")])
    assert dataset_profile(df).first()["n_duplicate_rows"] == 2


def test_long_texts_differing_at_the_end_stay_apart(frame):
    base = "word " * 200
    df = frame(t=[base + "a", base + "b", base + "a"])
    row = Profile.of(df).named("t")
    assert row["n_unique"] == 2
    assert set(row["sample_values"]) == {base + "a", base + "b"}
    assert dataset_profile(df).first()["n_duplicate_rows"] == 1


def test_hot_value_and_top_values(frame):
    values = ["hot"] * 400 + [f"v{i % 30}" for i in range(600)]
    row = Profile.of(frame(c=values)).named("c")
    assert row["top_values"][0]["value"] == "hot" and row["top_values"][0]["n"] == 400
    assert len(row["top_values"]) == 10


def test_quartiles_do_not_depend_on_how_many_values_are_gathered(tables):
    from tablewright.operators import ordering
    from tablewright.operators.profile import numeric_columns

    df = tables("lineitem").select("l_quantity", "l_extendedprice", "l_discount")
    wanted = {c: [0.25, 0.5, 0.75] for c in numeric_columns(df)}
    assert ordering.exact_quantiles(df, wanted, gathered=30) == ordering.exact_quantiles(df, wanted, gathered=10**6)


def test_approximate_distinct_is_close(tables):
    df = tables("lineitem").select("l_partkey", "l_extendedprice")
    exact = {r["column"]: r["n_unique"] for r in column_profile(df).collect()}
    near = {r["column"]: r["n_unique"] for r in column_profile(df, distinct="approx").collect()}
    assert all(abs(near[c] - n) <= 0.1 * n for c, n in exact.items())


def test_nested_columns_are_unknown(tables):
    profile = Profile.of(tables("embeddings"))
    assert profile.named("embedding")["semantic_type"] == "unknown"
    assert profile.named("embedding")["n_unique"] is None


def test_odd_column_names(frame):
    df = frame(**{"a.b": [1.5, 2.5, 3.5, 4.5], "with space": ["p", "q", "p", "r"], "tick`s": [1, 2, 3, 4]})
    assert {r["column"] for r in Profile.of(df).rows} == {"a.b", "with space", "tick`s"}


def test_observations_name_the_worst_gap(frame):
    df = frame(id=list(range(50)), x=[None if i % 2 else float(i) / 7 for i in range(50)], y=[None] + [float(i) / 3 for i in range(49)])
    seen = observations(Profile.of(df).frame).first()
    assert seen["identifiers"] == "id"
    assert (seen["worst_gap_column"], seen["worst_gap_pct"], seen["n_columns_with_gaps"]) == ("x", 50.0, 2)


def test_random_quantiles_agree_with_percentile(spark):
    from pyspark.sql import functions as F

    from tablewright.operators.ordering import exact_quantiles

    rng = random.Random(7)
    # a third of all rows share one value
    values = [5.0] * 700 + [rng.choice([rng.gauss(0, 1), rng.expovariate(0.01), float(rng.randint(0, 9))]) for _ in range(1400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    wanted = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.9, 0.99, 1.0]
    expected = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in wanted]))).first()[0]
    for gathered in (4_000, 50, 3):
        assert exact_quantiles(df, {"x": wanted}, gathered=gathered)["x"] == pytest.approx(expected, rel=1e-12)


def test_quartiles_of_many_columns_take_few_jobs(spark, tables):
    """Bounds of all columns and statistics are narrowed together: jobs do not grow with the columns."""
    from tablewright.operators.ordering import exact_quantiles

    df = tables("lineitem").selectExpr(*[f"l_extendedprice * {k + 1} + l_quantity AS c{k}" for k in range(6)])
    spark.sparkContext.setJobGroup("few-jobs", "quartiles")
    found = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in df.columns})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 20
    expected = df.selectExpr(*[f"percentile({c}, array(0.25, 0.5, 0.75)) AS {c}" for c in df.columns]).first()
    assert all(found[c] == pytest.approx(expected[c], rel=1e-12) for c in df.columns)


def test_quantiles_at_the_ends_of_the_number_range(spark):
    from tablewright.operators.ordering import exact_quantiles

    inf, most = float("inf"), 1.7976931348623157e308
    for values in ([-inf, -most, 0.0, 5e-324, most, inf], [0.0, 5e-324], [most, inf], [None, float("nan"), 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        there = sorted(v for v in values if v is not None and v == v)
        assert exact_quantiles(df, {"x": [0.0, 1.0]}, gathered=5)["x"] == [there[0], there[-1]]
