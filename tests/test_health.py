import pytest

from tablewright.operators import health
from tablewright.operators.frequency import duplicate_rows


def issues(df):
    return {(r["category"], r["column"]): r for r in health.health_issues(df).collect()}


# Made-up records of a lending library for tools.
def loans(spark, n=60):
    spellings = ["drill", "Drill", " drill", "saw", "plane", "plane "]
    rows = [
        (k, 2.5 + k % 7 * 0.5 if k != 31 else 940.0, spellings[k % 6], "main street", "late" if k in (8, 40) else "in time", None if k % 12 else "chipped", k * 0.75)
        for k in range(n)
    ]
    rows += [rows[3], rows[3], rows[20]]
    schema = "loan int, days double, tool string, branch string, back string, damage string, fee double"
    return spark.createDataFrame(rows, schema)


def test_issues_of_the_loans(spark):
    found = issues(loans(spark))
    gap = found["missing_values", "damage"]
    assert (gap["severity"], gap["advice"]) == ("critical", "drop_column") and gap["pct"] == pytest.approx(100 * 58 / 63, abs=0.01)
    assert found["duplicate_rows", None]["n_affected"] == 3
    assert found["constant_column", "branch"]["severity"] == "medium"
    assert found["outliers", "days"]["n_affected"] == 1 and found["outliers", "days"]["severity"] == "low"
    assert found["class_imbalance", "back"]["severity"] == "high"
    assert (found["inconsistent_values", "tool"]["n_levels"], found["inconsistent_values", "tool"]["n_affected"]) == (6, 3)
    assert ("outliers", "fee") not in found


def test_rare_and_many_levels(frame):
    values = [f"v{i % 60}" for i in range(600)] + ["once"]
    found = issues(frame(c=values))
    assert found["rare_category", "c"]["examples"] == ["once"]
    assert found["high_cardinality", "c"]["n_levels"] == 61


def test_clean_table_scores_well(frame):
    df = frame(age=[23, 35, 41, 29, 52, 38, 27, 46], city=["a", "b", "a", "b", "c", "c", "a", "b"])
    score = health.health_score(health.health_issues(df)).first()
    assert score["score"] >= 90 and score["grade"] == "A"


def test_no_issues_scores_100(spark):
    empty = spark.createDataFrame([], "category string, severity string")
    assert health.health_score(empty).first()["score"] == 100.0
    assert {r["score"] for r in health.quality_dimensions(empty).collect()} == {100}


def test_score_floor_and_dimensions(spark):
    many = spark.createDataFrame([("missing_values", "critical")] * 5 + [("outliers", "info")], "category string, severity string")
    assert health.health_score(many).first()["score"] == 0.0
    left = {r["dimension"]: r["score"] for r in health.quality_dimensions(many).collect()}
    assert left["completeness"] == 0 and left["distribution"] == 97


def test_issues_are_sorted_by_severity(frame):
    df = frame(
        _schema="a double, b string, c string",
        a=[None] * 9 + [1.0], b=["x"] * 10, c=["p", "P", "q", "q", "q", "q", "r", "r", "r", "r"],
    )
    ranks = [r["severity_rank"] for r in health.health_issues(df).collect()]
    assert ranks == sorted(ranks) and len(ranks) >= 3


def test_loans_from_a_file(spark, tmp_path):
    from tablewright.sources.tables import read_csv

    path = tmp_path / "loans.csv"
    loans(spark).toPandas().to_csv(path, index=False)
    df = read_csv(spark, str(path))
    assert dict(df.dtypes)["tool"] == "string" and dict(df.dtypes)["loan"] == "bigint"
    found = health.health_issues(df)
    categories = {r["category"] for r in found.collect()}
    assert {"missing_values", "duplicate_rows", "inconsistent_values", "class_imbalance", "constant_column", "outliers"} <= categories
    assert health.health_score(found).first()["score"] < 60


def test_health_change(frame):
    before = frame(x=[1.5, 2.5, 3.5, 4.5], fixed=["k"] * 4)
    change = health.health_change(health.health_issues(before), health.health_issues(before.drop("fixed"))).first()
    assert change["delta"] == pytest.approx(6.0)


def test_labels_are_cleaned_once_and_shared(spark):
    df = loans(spark)
    counts = health.label_counts(df, ["tool", "damage"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in health.level_summary(df, ["tool"], 63, counts=counts.where("column = 'tool'")).collect()] == [("tool", 6, 3, 0, 0)]
    long = [" " + "Q" * 90, "q" * 90, "ok", "OK "]
    found = health.label_counts(spark.createDataFrame([(x,) for x in long], "c string"), ["c"]).collect()
    assert len({r["raw"] for r in found}) == 4 and len({r["clean"] for r in found}) == 2


def test_equal_rows_are_found_by_hash_and_compared_whole(spark):
    rows = [(k, float(k), f"t{k}") for k in range(40)] + [(3, 3.0, "t3"), (0, -0.0, "t0"), (None, 1.0, "x"), (None, 1.0, "x")]
    found = duplicate_rows(spark.createDataFrame(rows, "a int, b double, c string"))
    assert tuple(found.first()) == (44, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    # a missing value does not change the hash, so these two rows share theirs
    assert tuple(duplicate_rows(spark.createDataFrame([("a", None), (None, "a"), ("b", "c"), ("d", "e"), ("f", "g")], "x string, y string")).first()) == (5, 0)
    assert tuple(duplicate_rows(spark.createDataFrame([(1,), (2,)], "x int")).first()) == (2, 0)
    assert tuple(duplicate_rows(spark.createDataFrame([("A",), ("a",), ("b",)], "x string collate UTF8_LCASE")).first()) == (3, 1)
    assert tuple(duplicate_rows(spark.createDataFrame([], "x int")).first()) == (0, 0)
