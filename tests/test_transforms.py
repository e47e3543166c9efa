import datetime as dt
import math

import pytest

from tablewright.operators import suggestions, transforms
from tablewright.operators.transforms import TransformError, apply_transform


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture()
def boats(frame):
    """Seven boats of a made-up harbour."""
    return frame(
        tonnage=[0.8, 14.5, 3.2, 3.2, 61.0, 9.9, 5.5], crew=[1, 6, 2, 2, 11, 4, 3],
        rig=["sloop", "ketch", "sloop", "yawl", "ketch", "sloop", "cat"], berth=[12, 3, 44, 45, 1, 9, 30],
        launched=["1998-05-17", "07/30/2004", "unknown", "1931/11/08", None, "2016-02-29 06:15", "1998-05-18"],
    )


def test_log_uses_log1p_at_zero(frame):
    out = column(apply_transform(frame(x=[0.0, 1.0, 2.0, 3.0]), "log_transform", ["x"]), "x_log")
    assert out == pytest.approx([0.0, math.log(2), math.log(3), math.log(4)])


def test_log_keeps_the_original(boats):
    out = apply_transform(boats, "log_transform", ["tonnage"])
    assert column(out, "tonnage_log")[4] == pytest.approx(math.log(61.0))
    assert column(out, "tonnage") == column(boats, "tonnage") and "tonnage_log" not in boats.columns


def test_sqrt_of_negative_is_zero(frame):
    assert column(apply_transform(frame(x=[-4.0, 9.0, None]), "sqrt_transform", ["x"]), "x_sqrt") == [0.0, 3.0, None]


def test_standard_scale_uses_population_spread(frame):
    out = column(apply_transform(frame(x=[1.0, 2.0, 3.0]), "standard_scale", ["x"]), "x")
    assert out == pytest.approx([-1.224745, 0.0, 1.224745], abs=1e-6)


def test_constant_columns_are_not_scaled(frame):
    df = frame(x=[5.0, 5.0])
    assert column(apply_transform(df, "standard_scale", ["x"]), "x") == [5.0, 5.0]
    assert column(apply_transform(df, "minmax_scale", ["x"]), "x") == [5.0, 5.0]


def test_minmax(boats):
    out = column(apply_transform(boats, "minmax_scale", ["crew"]), "crew")
    assert out == pytest.approx([0.0, 0.5, 0.1, 0.1, 1.0, 0.3, 0.2])


def test_clip_keeps_gaps(frame):
    df = frame(x=[1.0, 50.0, None, 200.0])
    out = column(apply_transform(df, "clip_outliers", ["x"], {"lower_bound": 10, "upper_bound": 100}), "x")
    assert out == [10.0, 50.0, None, 100.0]


def test_bins_are_closed_on_the_right(frame):
    out = column(apply_transform(frame(x=[float(i) for i in range(1, 9)]), "bin_numeric", ["x"]), "x_binned")
    assert out == [0, 0, 1, 1, 2, 2, 3, 3]
    out = column(apply_transform(frame(x=[1.0, 1.0, 1.0, 1.0, 2.0]), "bin_numeric", ["x"]), "x_binned")
    assert out == [0, 0, 0, 0, 0]


def test_one_hot(boats, frame):
    out = apply_transform(boats, "one_hot_encode", ["rig"])
    assert out.columns[-4:] == ["rig_cat", "rig_ketch", "rig_sloop", "rig_yawl"] and "rig" not in out.columns
    assert column(out, "rig_ketch") == [False, True, False, False, True, False, False]
    out = apply_transform(frame(q=["yes", "Yes", None], n=[10, 9, 10], b=[True, None, False]), "one_hot_encode", ["q", "n", "b"])
    assert out.columns == ["q_Yes", "q_yes_2", "n_9", "n_10", "b_false", "b_true"]
    assert column(out, "q_yes_2") == [True, False, False] and column(out, "n_10") == [True, False, True]


def test_one_hot_vectors_take_many_labels(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id", "concat('k', lpad(id, 6, '0')) AS code", "if(id % 4 = 3, NULL, id % 4) AS quarter")
    out, index = transforms.one_hot_vectors(df, ["code", "quarter"])
    assert out.columns == ["id", "code_vector", "quarter_vector"]
    assert index.where("column = 'code'").count() == n
    for r in out.where("id IN (0, 77, 99998, 99999)").collect():
        assert r["code_vector"].size == n and list(r["code_vector"].indices) == [r["id"]] and list(r["code_vector"].values) == [1.0]
        assert r["quarter_vector"].size == 3 and list(r["quarter_vector"].indices) == ([] if r["id"] % 4 == 3 else [r["id"] % 4])
    places = {(r["column"], r["label"]): r["position"] for r in index.where("position < 3").collect()}
    assert places["code", "k000002"] == 2 and places["quarter", "1"] == 1


def test_one_hot_vectors_of_a_column_without_labels(spark):
    df = spark.createDataFrame([(None, "x"), (None, None)], "a string, `b.c` string")
    out, index = transforms.one_hot_vectors(df, ["a", "b.c"])
    rows = out.collect()
    assert all(r["a_vector"].size == 1 and not len(r["a_vector"].indices) for r in rows)
    assert sorted(len(r["b.c_vector"].indices) for r in rows) == [0, 1] and index.count() == 1


def test_ordinal_sorts_labels_and_keeps_gaps(frame):
    df = frame(c=["plum", "fig", None, "quince", "fig"], n=[30, 4, 4, None, 100])
    rows = apply_transform(df, "ordinal_encode", ["c", "n"]).collect()
    assert sorted(((r["c"], r["n"]) for r in rows), key=str) == sorted([(1, 1), (0, 0), (None, 0), (2, None), (0, 2)], key=str)


def test_frequency_counts_present_rows_only(frame):
    out = apply_transform(frame(c=["a", "a", "b", None]), "frequency_encode", ["c"])
    assert {(r["c"], r["c_freq"] and round(r["c_freq"], 4)) for r in out.collect()} == {("a", 0.6667), ("b", 0.3333), (None, None)}


def test_group_rare(frame):
    df = frame(c=["big"] * 99 + ["small", None])
    values = column(apply_transform(df, "group_rare", ["c"]), "c")
    assert values.count("Other") == 1 and values.count("big") == 99 and values.count(None) == 1


def test_columns_without_rare_labels_keep_their_type(frame):
    df = frame(n=[1, 2] * 60, m=[1] * 119 + [2])
    out = apply_transform(df, "group_rare", ["n", "m"])
    assert dict(out.dtypes) == {"n": "bigint", "m": "string"} and set(column(out, "m")) == {"1", "Other"}


def test_dates(boats, frame):
    rows = apply_transform(boats, "extract_datetime_parts", ["launched"]).collect()
    assert (rows[0]["launched_year"], rows[0]["launched_dayofweek"], rows[0]["launched_is_weekend"]) == (1998, 6, 1)
    assert [r["launched_year"] for r in rows] == [1998, 2004, None, 1931, None, 2016, 1998] and rows[2]["launched_is_weekend"] == 0
    out = apply_transform(frame(d=[dt.date(2024, 1, 1)]), "extract_datetime_parts", ["d"]).first()
    assert (out["d_dayofweek"], out["d_month"]) == (0, 1)


def test_drop_and_text(boats, frame):
    assert "berth" not in apply_transform(boats, "drop_column", ["berth"]).columns
    assert column(apply_transform(frame(x=[1.5, float("nan")]), "text_feature", ["x"]), "x_length") == [3, 0]
    out = column(apply_transform(frame(note=["hi", "hello", "", None]), "text_feature", ["note"]), "note_length")
    assert out == [2, 5, 0, 0]


def test_errors(boats):
    with pytest.raises(TransformError):
        apply_transform(boats, "log_transform", ["nope"])
    with pytest.raises(TransformError):
        apply_transform(boats, "no_such_transform", ["tonnage"])
    with pytest.raises(TransformError):
        apply_transform(boats, "log_transform", ["rig"])
    with pytest.raises(TransformError):
        apply_transform(boats, "extract_datetime_parts", ["rig"])


# ---- suggestions -----------------------------------------------------------------------------


def suggested(df, target=None):
    return [(r["transform"], tuple(r["columns"])) for r in suggestions.feature_suggestions(df, target).collect()]


def test_suggestions_for_each_kind(frame):
    n = 200
    df = frame(
        id=[f"u{i}" for i in range(n)], tail=[math.exp(i / 25) for i in range(n)], small=[i % 7 * 0.1 + 0.05 for i in range(n)],
        sex=["m", "f"] * (n // 2), city=[f"c{i % 5}" for i in range(n)], many=[f"m{i % 40}" for i in range(n)], same=["k"] * n,
        day=[dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)],
        note=[f"some longer note about item {i} here" for i in range(n)],
    )
    found = suggested(df)
    for wanted in [
        ("drop_column", ("id",)), ("drop_column", ("same",)), ("text_feature", ("note",)), ("one_hot_encode", ("city",)),
        ("frequency_encode", ("many",)), ("ordinal_encode", ("sex",)), ("extract_datetime_parts", ("day",)),
        ("standard_scale", ("tail", "small")),
    ]:
        assert wanted in found, wanted
    assert ("log_transform", ("tail",)) in found or ("sqrt_transform", ("tail",)) in found
    order = [suggestions.PRIORITY_WEIGHT[r["priority"]] for r in suggestions.feature_suggestions(df).collect()]
    assert order == sorted(order, reverse=True)


def test_target_is_left_alone(frame):
    df = frame(city=["a", "b", "c"] * 20, x=[i * 0.5 for i in range(60)])
    assert ("one_hot_encode", ("city",)) in suggested(df)
    assert ("one_hot_encode", ("city",)) not in suggested(df, "city")


def test_zero_one_flags_need_no_encoding(frame):
    assert suggested(frame(flag=[0, 1] * 10, x=[i * 0.5 for i in range(20)])) == []
