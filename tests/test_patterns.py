import numpy as np
import pandas as pd
import pytest

from tablewright.operators import patterns, significance
from tablewright.operators.profile import Profile


# A made-up log of a cheese cellar: what is weighed, how warm it is, who turns the wheels.
def cellar(frame, n=48):
    days = [3.25 * k + 0.4 for k in range(n)]
    return frame(
        days=days, loss=[0.07 * d + 0.2 for d in days], moisture=[61.5 - 0.11 * d for d in days], rind=[1.03**d for d in days],
        room=["north" if k % 3 else "south" for k in range(n)],
        degrees=[11.4 + 0.01 * k if k % 3 else 14.9 - 0.01 * k for k in range(n)],
        turned=["Ada" if k not in (5, 17) else "Ben" for k in range(n)],
        orders=[2.5 + 0.25 * (k % 9) for k in range(n - 2)] + [333.5, 777.25],
    )


def test_lines_and_curves_of_the_cellar(frame):
    df = cellar(frame).select("days", "loss", "moisture", "rind")
    found = {(r["col_a"], r["col_b"]): r for r in patterns.correlation_findings(df).collect()}
    rising, falling = found["days", "loss"], found["days", "moisture"]
    assert (rising["direction"], rising["strength"], rising["score"]) == ("positive", "very_strong", 1.0)
    assert falling["direction"] == "negative"
    curve = found["days", "rind"]
    assert curve["spearman_r"] == 1.0 and curve["pearson_r"] < 0.9


def test_rooms_differ_in_warmth(frame):
    row = patterns.group_difference_findings(cellar(frame).select("room", "degrees")).first()
    assert (row["highest"], row["lowest"]) == ("south", "north")


def test_rare_large_orders_skew_and_need_no_test(frame):
    row = patterns.skew_findings(Profile.of(cellar(frame).select("orders")).frame).first()
    assert row["direction"] == "right" and row["needs_test"] is False


def test_one_person_turns_nearly_all(frame):
    row = patterns.dominant_findings(Profile.of(cellar(frame).select("turned", "days")).frame).first()
    assert row["top_level"] == "Ada" and row["top_pct"] == pytest.approx(100 * 46 / 48, abs=0.01)
    assert row["score"] == pytest.approx((100 * 46 / 48 - 50) / 50, abs=1e-4)


def test_findings_are_sorted(tables):
    df = tables("lineitem").selectExpr("l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_quantity", "l_quantity > 25 AS big")
    scores = [r["score"] for r in patterns.findings(df, "big").collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) >= 2


@pytest.mark.parametrize("broadcast", [50_000, 10])
def test_spearman_equals_pandas_with_ties_and_gaps(spark, broadcast, monkeypatch):
    rng = np.random.default_rng(3)
    n = 400
    data = pd.DataFrame({"a": rng.integers(0, 6, n).astype(float), "b": rng.normal(size=n), "c": rng.exponential(size=n)})
    data["b"] += data["a"]
    data.loc[rng.random(n) < 0.2, "c"] = np.nan
    data.loc[:130, "a"] = 3.0
    monkeypatch.setattr(patterns, "FEW_VALUES", broadcast)
    df = spark.createDataFrame(data)
    pairs = patterns.all_pairs(["a", "b", "c"])
    found = {(r["col_a"], r["col_b"]): r["spearman_r"] for r in patterns.spearman(df, pairs).collect()}
    # ranks by hand: scipy is not needed
    for a, b in pairs:
        both = data[[a, b]].dropna().rank()
        assert found[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


@pytest.mark.parametrize("in_turn", [3, 0])
def test_ranks_of_many_values_are_joined_in_turn_or_by_row(spark, in_turn, monkeypatch):
    rng = np.random.default_rng(12)
    data = pd.DataFrame(rng.normal(size=(300, 3)), columns=list("abc"))
    data["b"] += data["a"]
    data.loc[:90, "a"] = 1.5
    data.loc[rng.random(300) < 0.3, "c"] = np.nan
    written, own = [], patterns.cut_lineage
    monkeypatch.setattr(patterns, "FEW_VALUES", 10)
    monkeypatch.setattr(patterns, "JOINED_IN_TURN", in_turn, raising=False)
    monkeypatch.setattr(patterns, "cut_lineage", lambda df: written.append(df.columns) or own(df))
    pairs = patterns.all_pairs(list("abc"))
    found = {(r["col_a"], r["col_b"]): r["spearman_r"] for r in patterns.spearman(spark.createDataFrame(data), pairs).collect()}
    assert any("row" in columns for columns in written) == (in_turn == 0)
    for a, b in pairs:
        both = data[[a, b]].dropna().rank()
        assert found[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


def test_sixty_columns_with_three_kinds_of_gaps(spark):
    rng = np.random.default_rng(17)
    n, columns = 300, [f"c{i}" for i in range(60)]
    data = pd.DataFrame(rng.integers(0, 40, (n, 60)).astype(float), columns=columns)
    data["c31"] += 3 * data["c2"]
    gaps = [rng.random(n) < 0.15, rng.random(n) < 0.3]
    gaps.append(gaps[0] | gaps[1])
    for i, c in enumerate(columns):
        data.loc[gaps[i % 3], c] = np.nan
    df = spark.createDataFrame(data)
    together = patterns.rows_together(df, columns)
    assert together["c0", "c1"] == int((~gaps[2]).sum()) and together["c1", "c4"] == int((~gaps[1]).sum())
    pairs = patterns.all_pairs(columns)
    ranked, names = patterns.gap_views(pairs, together)
    # a column with the gaps of both other kinds needs one ranking, the rest one for itself and one for the rows of all three
    assert len(pairs) == len(names) == 1770 and len(ranked) <= 20 * 1 + 40 * 3
    some = [("c0", "c1"), ("c0", "c2"), ("c1", "c4"), ("c2", "c5"), ("c2", "c31"), ("c31", "c58"), ("c59", "c0")]
    found = {(r["col_a"], r["col_b"]): r["spearman_r"] for r in patterns.spearman(df, some).collect()}
    for a, b in some:
        both = data[[a, b]].dropna().rank()
        assert found[a, b] == pytest.approx(both[a].corr(both[b]), abs=1e-12)


def test_more_rank_tables_than_one_job_takes(spark, monkeypatch):
    monkeypatch.setattr(patterns, "TABLES_PER_JOB", 2)
    data = pd.DataFrame(np.random.default_rng(8).integers(0, 9, (200, 5)).astype(float), columns=list("abcde"))
    found = {(r["col_a"], r["col_b"]): r["spearman_r"] for r in patterns.spearman(spark.createDataFrame(data), patterns.all_pairs(list("abcde"))).collect()}
    for (a, b), rho in found.items():
        assert rho == pytest.approx(data[a].rank().corr(data[b].rank()), abs=1e-12)


def test_pearson_ignores_incomplete_pairs(frame):
    row = patterns.pearson(frame(a=[1.0, 2.0, 3.0, None, 5.0], b=[2.0, 4.0, None, 1.0, 10.0]), [("a", "b")]).first()
    assert row["n"] == 3 and row["pearson_r"] == pytest.approx(1.0)


def test_all_pairs_in_one_pass_equal_pandas(spark):
    rng = np.random.default_rng(31)
    data = pd.DataFrame(rng.normal(loc=1e6, scale=2.0, size=(500, 9)), columns=list("abcdefghi"))
    data["b"] += data["a"]
    data["f"] = 7.25
    data = data.mask(rng.random(data.shape) < 0.1)
    pairs = patterns.all_pairs(list(data.columns))
    found = {(r["col_a"], r["col_b"]): r for r in patterns.pearson(spark.createDataFrame(data).repartition(5), pairs).collect()}
    for a, b in pairs:
        assert found[a, b]["n"] == len(data[[a, b]].dropna())
        if "f" in (a, b):
            assert found[a, b]["pearson_r"] is None
        else:
            assert found[a, b]["pearson_r"] == pytest.approx(data[a].corr(data[b]), abs=1e-9)


# ---- tests of significance -------------------------------------------------------------------


def one(tests):
    return significance.with_p_values(tests).first()




def test_correlation_tests(spark):
    rng = np.random.default_rng(77)
    hops, minutes = rng.uniform(0, 9, 64), rng.uniform(20, 90, 64)
    df = spark.createDataFrame(pd.DataFrame({"hops": hops, "bitterness": 4 * hops + rng.normal(scale=2.0, size=64), "minutes": minutes}))
    row = one(significance.correlation_tests(df, [("hops", "bitterness")]))
    assert (row["significance"], row["effect_size"]) == ("significant", "large")
    r = np.corrcoef(hops, minutes)[0, 1]
    row = one(significance.correlation_tests(df, [("hops", "minutes")]))
    assert row["statistic"] == pytest.approx(r) and (row["significance"] == "significant") == (row["p_value"] < 0.05)


def test_too_few_rows_are_inconclusive(frame):
    row = one(significance.correlation_tests(frame(a=[0.5, 1.5, 0.25, 9.0], b=[3.0, 1.0, 8.0, 2.0]), [("a", "b")]))
    assert row["significance"] == "inconclusive" and row["statistic"] is None and row["p_value"] is None


def test_two_kilns_and_three_clays(spark):
    rng = np.random.default_rng(5)
    shrink = np.concatenate([rng.normal(6.1, 0.8, 26), rng.normal(9.4, 1.1, 33)])
    df = spark.createDataFrame(pd.DataFrame({"shrink": shrink, "kiln": ["gas"] * 26 + ["wood"] * 33}))
    row = one(significance.group_tests(df, [("shrink", "kiln")]))
    assert (row["test_kind"], row["significance"], row["effect_size"]) == ("t_test", "significant", "large")
    # the larger group comes first, and its mean is higher
    assert row["first_group"] == "wood" and row["statistic"] > 0 and row["effect_value"] < 0
    shrink = np.concatenate([rng.normal(m, 1.0, 21) for m in (5.0, 5.2, 8.8)])
    df = spark.createDataFrame(pd.DataFrame({"shrink": shrink, "clay": ["grey"] * 21 + ["red"] * 21 + ["white"] * 21}))
    row = one(significance.group_tests(df, [("shrink", "clay")]))
    assert (row["test_kind"], row["effect_metric"], row["significance"]) == ("anova", "eta_squared", "significant")


def test_groups_without_spread_and_different_means(frame):
    row = one(significance.group_tests(frame(v=[2.0] * 6 + [3.0] * 7, g=["a"] * 6 + ["b"] * 7), [("v", "g")]))
    assert row["statistic"] == float("inf") and row["p_value"] == 0.0 and row["significance"] == "significant"
    row = one(significance.group_tests(frame(v=[2.0] * 13, g=["a"] * 6 + ["b"] * 7), [("v", "g")]))
    assert row["statistic"] is None and row["significance"] == "not_significant"


def test_levels_may_be_named_like_anything(frame):
    df = frame(x=["A", "a", "b", "n", None], y=["a", "B", "b", "a", "b"])
    found = {(r["a"], r["b"]): r["n"] for r in significance.contingency_table(df, "x", "y").collect()}
    assert len(found) == 4 * 3 and sum(found.values()) == 4 and found["A", "a"] == found["a", "B"] == 1


def test_contingency_of_many_levels_is_formed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(significance, "CELLS_PER_BLOCK", 1_000)
    df = spark.range(3000).selectExpr("concat('a', id % 700) AS x", "if(id = 5, NULL, id % 90) AS y")
    table = significance.contingency_table(df, "x", "y")
    row = table.selectExpr("count(*) AS cells", "count(DISTINCT a) AS a", "count(DISTINCT b) AS b", "sum(n) AS n").first()
    assert (row["cells"], row["a"], row["b"], row["n"]) == (700 * 90, 700, 90, 2999)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "row_block" in plan and "column_block" in plan and "Cartesian" not in plan


def test_small_groups_are_inconclusive(frame):
    row = one(significance.group_tests(frame(v=[1.0, 2.0, 3.0, 4.0, 5.0, 6.0], g=["a"] * 5 + ["b"]), [("v", "g")]))
    assert row["significance"] == "inconclusive"


def test_chi_square_two_by_two_uses_the_correction(spark):
    rows = [("x", "yes")] * 60 + [("y", "no")] * 60 + [("x", "no")] * 5 + [("y", "yes")] * 5
    row = one(significance.chi_square_tests(spark.createDataFrame(rows, ["grp", "outcome"]), [("grp", "outcome")]))
    # by hand: every expected count is 32.5, every gap 27.5 less one half
    assert row["statistic"] == pytest.approx(4 * 27.0**2 / 32.5)
    assert row["significance"] == "significant" and row["effect_value"] > 0.3


def test_chi_square_with_empty_cells(spark):
    rows = [("a", "p")] * 10 + [("b", "q")] * 8 + [("c", "q")] * 4 + [("c", "r")] * 6
    row = significance.chi_square_tests(spark.createDataFrame(rows, ["x", "y"]), [("x", "y")]).first()
    table = np.array([[10, 0, 0], [0, 8, 0], [0, 4, 6]], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert row["statistic"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row["min_expected"] == pytest.approx(expected.min())


def test_one_level_is_inconclusive(frame):
    row = one(significance.chi_square_tests(frame(a=["x"] * 10, b=["p", "q"] * 5), [("a", "b")]))
    assert row["significance"] == "inconclusive"


def test_tails_agree_with_the_math_library(spark):
    jvm = spark._jvm.org.apache.commons.math3.distribution
    cases = []
    for t, dof in [(0.0, 3.0), (0.5, 1.0), (2.1, 7.5), (-3.3, 40.0), (12.0, 88.2), (1.96, 1e6)]:
        cases.append(("t", t, dof, None, 2 * jvm.TDistribution(dof).cumulativeProbability(-abs(t))))
    for f, d1, d2 in [(0.3, 2.0, 30.0), (1.0, 5.0, 5.0), (3.7, 4.0, 120.0), (9.5, 1.0, 12.0)]:
        cases.append(("f", f, d1, d2, 1 - jvm.FDistribution(d1, d2).cumulativeProbability(f)))
    for x, k in [(0.0, 3.0), (0.4, 1.0), (3.84, 1.0), (15.0, 9.0), (80.0, 60.0), (2.5, 14.0), (900.0, 1000.0)]:
        cases.append(("chi2", x, k, None, 1 - jvm.ChiSquaredDistribution(k).cumulativeProbability(x)))
    df = spark.createDataFrame([c[:4] for c in cases], "kind string, s double, d1 double, d2 double").coalesce(1)
    from tablewright.functions.tails import tail_probability

    got = [r[0] for r in df.select(tail_probability("kind", "s", "d1", "d2")).collect()]
    for case, p in zip(cases, got):
        assert p == pytest.approx(case[4], rel=1e-8, abs=1e-13), case


def test_large_degrees_of_freedom(spark):
    import math

    from tablewright.functions import tails

    def p(kind, statistic, d1, d2=np.nan):
        return tails._tails(np.array([kind], dtype=object), np.array([statistic]), np.array([d1]), np.array([d2]))[0]

    assert p("t", 1.959963984540054, 1e12) == pytest.approx(0.05, rel=1e-9)
    assert p("f", 3.0, 2.0, 1e10) == pytest.approx(math.exp(-3.0), rel=1e-8)
    # the mean of a chi-square stands a third of a standard normal density above its median
    for k in (1e8, 1e10):
        assert p("chi2", k, k) == pytest.approx(0.5 - 1 / (3 * math.sqrt(math.pi * k)), rel=1e-9)
    assert p("f", 1.0, 4e6, 4e6) == pytest.approx(0.5, abs=1e-9)


def test_expansions_meet_the_series(monkeypatch):
    from tablewright.functions import tails

    for z in (-3.0, -0.5, 0.0, 1e-3, 0.7, 4.0):
        a, p, q = (np.array([v]) for v in (9e4, 4e4, 8e4))
        x = a + z * np.sqrt(a)
        y = p / (p + q) + z * np.sqrt(p * q / (p + q) ** 3)
        by_limit = []
        for limit in (1e6, 1e3):
            monkeypatch.setattr(tails, "LARGE", limit)
            by_limit.append((tails.gamma_tail(a, x)[0], tails.beta_tail(p, q, y)[0]))
        assert by_limit[0] == pytest.approx(by_limit[1], abs=5e-9)


def test_far_tails_do_not_cancel(spark):
    from tablewright.functions.tails import _tails

    p = _tails(np.array(["f", "t", "chi2"], dtype=object), np.array([500.0, 60.0, 400.0]), np.array([2.0, 50.0, 3.0]), np.array([100.0, np.nan, np.nan]))
    # F with two numerator degrees has the closed form (1 + d1 f / d2) ** (-d2 / 2)
    assert p[0] == pytest.approx((1 + 2 * 500.0 / 100.0) ** -50.0, rel=1e-9)
    assert 0 < p[1] < 1e-40 and 0 < p[2] < 1e-80


def test_all_tests_are_corrected_and_counted_once(tables):
    df = tables("lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net", "l_returnflag",
        "CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END AS halves",
    )
    tests = significance.significance_tests(df, "halves").collect()
    keys = [(t["test_kind"], frozenset((t["col_a"], t["col_b"]))) for t in tests]
    assert len(keys) == len(set(keys)) >= 3
    assert all(t["bonferroni_alpha"] == pytest.approx(0.05 / len(tests)) for t in tests)
    assert {t["test_kind"] for t in tests} == {"pearson_correlation", "t_test", "chi_square"}


def test_tests_use_the_coefficients_of_the_findings(spark, monkeypatch):
    """Ranks are found once for findings and tests, and the tests do not change by that."""
    calls, own = [], patterns.spearman
    monkeypatch.setattr(patterns, "spearman", lambda *a, **k: calls.append(1) or own(*a, **k))
    monkeypatch.setattr(significance, "spearman", patterns.spearman)
    rows = [(float(i * 37 % 101), float(i * 37 % 101) ** 2 + 0.5 * (i % 3), float(i % 7), "ab"[i % 2]) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, z double, g string")
    found = significance.significance_tests(df, "g").where("test_kind = 'pearson_correlation'").collect()
    assert len(calls) == 1 and found
    pairs = [(r["col_a"], r["col_b"]) for r in found]
    alone = {(r["col_a"], r["col_b"]): r for r in significance.correlation_tests(df, pairs).collect()}
    for r in found:
        other = alone[r["col_a"], r["col_b"]]
        assert all(r[k] == pytest.approx(other[k], abs=1e-12) for k in ("n", "statistic", "spearman_r", "effect_value"))
