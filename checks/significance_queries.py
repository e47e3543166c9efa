"""Statistical tests: statistics and effects against SQL; p-values are checked by the test suite."""

from pyspark.sql import functions as F

from tablewright.functions.tails import tail_probability
from tablewright.operators import significance
from tablewright.operators.profile import Profile

from .pattern_queries import ALL_FINDINGS, PAIRS, pearson_sql, spearman_sql
from .relations import LABELS, ORDERS, PLANTED, Relation, query

CORRELATION_PAIRS = [("l_extendedprice", "net"), ("l_quantity", "l_tax"), ("net", "gap")]


def label_sql(metric: str, value: str) -> str:
    cuts = {"pearson_r": (0.1, 0.3, 0.5), "cohens_d": (0.2, 0.5, 0.8), "eta_squared": (0.01, 0.06, 0.14), "cramers_v": (0.1, 0.3, 0.5)}
    a, b, c = cuts[metric]
    return (
        f"CASE WHEN abs({value}) < {a} THEN 'negligible' WHEN abs({value}) < {b} THEN 'small' "
        f"WHEN abs({value}) < {c} THEN 'medium' ELSE 'large' END"
    )


@query(
    "correlation_tests",
    f"""WITH p AS ({pearson_sql(PLANTED, CORRELATION_PAIRS)}), s AS ({spearman_sql(PLANTED, CORRELATION_PAIRS)})
SELECT col_a, col_b, n, round(r, 4) AS statistic, round(rho, 4) AS spearman_r, (n - 2)::DOUBLE AS dof1,
abs(rho) - abs(r) > 0.15 AS curved, {label_sql('pearson_r', 'r')} AS effect_size FROM p JOIN s USING (col_a, col_b)""",
)
def correlation_tests(spark, sf_dir):
    tests = significance.with_p_values(significance.correlation_tests(PLANTED.read(spark, sf_dir), CORRELATION_PAIRS))
    return tests.select(
        "col_a", "col_b", "n", F.round("statistic", 4).alias("statistic"), F.round("spearman_r", 4).alias("spearman_r"),
        "dof1", "curved", "effect_size",
    )


def welch_sql(rel: Relation, measure: str, group: str) -> str:
    return f"""(WITH g AS (SELECT {group}::VARCHAR AS level, count({measure}) AS n, avg({measure}) AS m, var_samp({measure}) AS v
  FROM {rel.sql} WHERE {group} IS NOT NULL GROUP BY 1 HAVING count({measure}) >= 5),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, level) AS i FROM g),
w AS (SELECT a.level AS l0, b.level AS l1, a.n AS n0, b.n AS n1, a.m AS m0, b.m AS m1, a.v AS v0, b.v AS v1
  FROM o a JOIN o b ON a.i = 1 AND b.i = 2)
SELECT '{measure}' AS col_a, '{group}' AS col_b, n0 + n1 AS n, l0 AS first_group, l1 AS second_group,
  round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 4) AS statistic,
  round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 2) AS dof1,
  round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 4) AS effect_value FROM w)"""


WELCH_PAIRS = [("l_quantity", "halves"), ("l_tax", "l_linestatus"), ("gap", "mostly")]


@query("welch_t_tests", " UNION ALL ".join(welch_sql(PLANTED, m, g) for m, g in WELCH_PAIRS))
def welch(spark, sf_dir):
    tests = significance.group_tests(PLANTED.read(spark, sf_dir), WELCH_PAIRS)
    return tests.select(
        "col_a", "col_b", "n", "first_group", "second_group", F.round("statistic", 4).alias("statistic"),
        F.round("dof1", 2).alias("dof1"), F.round("effect_value", 4).alias("effect_value"),
    )


def anova_sql(rel: Relation, measure: str, group: str) -> str:
    return f"""(WITH g AS (SELECT {group} AS level, count({measure}) AS n, avg({measure}) AS m, var_samp({measure}) AS v
  FROM {rel.sql} WHERE {group} IS NOT NULL GROUP BY 1 HAVING count({measure}) >= 5),
t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n * m) / sum(n) AS grand, sum((n - 1) * v) AS within FROM g),
b AS (SELECT sum(g.n * (g.m - t.grand) * (g.m - t.grand)) AS between_ FROM g, t)
SELECT '{measure}' AS col_a, '{group}' AS col_b, k, n, round((between_ / (k - 1)) / (within / (n - k)), 4) AS statistic,
  (k - 1)::DOUBLE AS dof1, (n - k)::DOUBLE AS dof2, round(between_ / (between_ + within), 4) AS effect_value,
  {label_sql('eta_squared', '(between_ / (between_ + within))')} AS effect_size FROM t, b)"""


ANOVA_PAIRS = [("l_quantity", "thirds"), ("l_extendedprice", "l_returnflag"), ("gap", "l_returnflag")]


@query("anova_tests", " UNION ALL ".join(anova_sql(PLANTED, m, g) for m, g in ANOVA_PAIRS))
def anova(spark, sf_dir):
    tests = significance.with_p_values(significance.group_tests(PLANTED.read(spark, sf_dir), ANOVA_PAIRS))
    return tests.select(
        "col_a", "col_b", "k", "n", F.round("statistic", 4).alias("statistic"), "dof1", "dof2",
        F.round("effect_value", 4).alias("effect_value"), "effect_size",
    )


def chi_square_sql(rel: Relation, a: str, b: str) -> str:
    return f"""(WITH p AS (SELECT {a} AS a, {b} AS b FROM {rel.sql} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY a, b), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY a),
s AS (SELECT b, sum(n) AS cb FROM c GROUP BY b), t AS (SELECT sum(n) AS total FROM c),
d AS (SELECT ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM s) - 1) AS dof,
  least((SELECT count(*) FROM r), (SELECT count(*) FROM s)) - 1 AS small),
e AS (SELECT coalesce(c.n, 0) AS n, ra * cb / total AS e FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = s.b),
x AS (SELECT sum(pow(abs(n - e) - CASE WHEN dof = 1 THEN least(0.5, abs(n - e)) ELSE 0 END, 2) / e) AS chi2,
  sum(n) AS total, min(e) AS least_e, any_value(dof) AS dof, any_value(small) AS small FROM e, d)
SELECT '{a}' AS col_a, '{b}' AS col_b, total::BIGINT AS n, round(chi2, 4) AS statistic, dof::DOUBLE AS dof1,
  round(sqrt(chi2 / (total * small)), 4) AS effect_value, least_e < 5 AS small_expected, round(least_e, 4) AS min_expected,
  {label_sql('cramers_v', 'sqrt(chi2 / (total * small))')} AS effect_size FROM x)"""


def chi_columns():
    return [
        "col_a", "col_b", "n", F.round("statistic", 4).alias("statistic"), "dof1",
        F.round("effect_value", 4).alias("effect_value"), "small_expected", F.round("min_expected", 4).alias("min_expected"),
        "effect_size",
    ]


CHI_PAIRS = [("l_returnflag", "l_linestatus"), ("thirds", "halves"), ("mostly", "halves"), ("thirds", "l_returnflag")]


@query("chi_square_tests", " UNION ALL ".join(chi_square_sql(PLANTED, a, b) for a, b in CHI_PAIRS))
def chi_square(spark, sf_dir):
    tests = significance.with_p_values(significance.chi_square_tests(PLANTED.read(spark, sf_dir), CHI_PAIRS))
    return tests.select(*chi_columns())


@query("chi_square_two_by_two", chi_square_sql(LABELS, "quality", "toxic"))
def chi_square_yates(spark, sf_dir):
    tests = significance.with_p_values(significance.chi_square_tests(LABELS.read(spark, sf_dir), [("quality", "toxic")]))
    return tests.select(*chi_columns())


SPARSE = Relation(
    "orders", ["o_orderpriority"],
    {"month": ("concat(CAST(year(o_orderdate) AS VARCHAR(9)), CASE WHEN o_orderpriority = '5-LOW' THEN 'x' ELSE '' END)", "s")},
)


@query("chi_square_with_empty_cells", chi_square_sql(SPARSE, "o_orderpriority", "month"))
def chi_square_sparse(spark, sf_dir):
    tests = significance.with_p_values(significance.chi_square_tests(SPARSE.read(spark, sf_dir), [("o_orderpriority", "month")]))
    return tests.select(*chi_columns())


CONTINGENCY = """WITH c AS (SELECT o_orderpriority AS a, month AS b, count(*) AS n FROM {rel} GROUP BY 1, 2),
grid AS (SELECT r.a, s.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) r CROSS JOIN (SELECT DISTINCT b FROM c) s
  LEFT JOIN c ON c.a = r.a AND c.b = s.b)""".format(rel=SPARSE.sql)


@query("contingency_table", CONTINGENCY + " SELECT a, b, n FROM grid")
def contingency(spark, sf_dir):
    return significance.contingency_table(SPARSE.read(spark, sf_dir), "o_orderpriority", "month")


@query(
    "expected_counts",
    CONTINGENCY + """ SELECT a, b, n, sum(n) OVER (PARTITION BY a)::BIGINT AS row_total, sum(n) OVER (PARTITION BY b)::BIGINT AS column_total,
sum(n) OVER ()::BIGINT AS total, round(sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER (), 4) AS expected FROM grid""",
)
def expected(spark, sf_dir):
    table = significance.contingency_table(SPARSE.read(spark, sf_dir), "o_orderpriority", "month")
    return significance.expected_counts(table).withColumn("expected", F.round("expected", 4))


CHOSEN = f"""WITH {ALL_FINDINGS}, typed AS (
  SELECT f.*, a.semantic_type IN ('numeric_continuous', 'numeric_discrete') AS num_a,
    b.semantic_type IN ('numeric_continuous', 'numeric_discrete') AS num_b
  FROM found f JOIN profile a ON a.col = f.col_a JOIN profile b ON b.col = f.col_b)
SELECT DISTINCT CASE WHEN num_a AND num_b THEN 'correlation' WHEN num_a OR num_b THEN 'group_difference' ELSE 'chi_square' END AS test_kind,
  col_a, col_b FROM typed"""


@query("chosen_tests", CHOSEN)
def chosen_tests(spark, sf_dir):
    from tablewright.operators.patterns import findings

    df = PLANTED.read(spark, sf_dir)
    p = Profile.of(df)
    return significance.chosen_tests(findings(df, "halves", p), p.frame).select("test_kind", "col_a", "col_b")


@query(
    "each_test_once",
    """WITH t AS (SELECT o_orderkey AS seq, o_orderstatus AS test_kind, least(o_orderpriority, o_orderstatus) AS x,
  greatest(o_orderpriority, o_orderstatus) AS y FROM orders)
SELECT test_kind, x, y, min(seq) AS seq FROM t GROUP BY test_kind, x, y""",
)
def each_test_once(spark, sf_dir):
    turn = F.col("o_orderkey") % 2 == 0
    tests = ORDERS.read(spark, sf_dir).select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("test_kind"),
        F.when(turn, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("col_a"),
        F.when(turn, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("col_b"),
    )
    kept = significance.each_test_once(tests)
    return kept.select(
        "test_kind", F.least("col_a", "col_b").alias("x"), F.greatest("col_a", "col_b").alias("y"), "seq"
    )


def _all_tests(spark, sf_dir):
    return significance.significance_tests(PLANTED.read(spark, sf_dir), "halves")


# statistics of every test the findings of PLANTED can call for
CORRELATION_STATS = f"""SELECT 'pearson_correlation' AS test_kind, col_a, col_b, n, round(r, 4) AS statistic, round(r, 4) AS effect_value
FROM ({pearson_sql(PLANTED, PAIRS)})"""
GROUP_STATS = " UNION ALL ".join(
    [
        f"SELECT 't_test' AS test_kind, col_a, col_b, n, statistic, effect_value FROM {welch_sql(PLANTED, 'l_quantity', g)}"
        for g in ("halves", "mostly", "l_linestatus")
    ]
    + [
        f"SELECT 'anova', col_a, col_b, n, statistic, effect_value FROM {anova_sql(PLANTED, 'l_quantity', g)}"
        for g in ("thirds", "l_returnflag")
    ]
)
CHI_STATS = " UNION ALL ".join(
    f"SELECT 'chi_square' AS test_kind, col_a, col_b, n, statistic, effect_value FROM {chi_square_sql(PLANTED, a, 'halves')}"
    for a in ("l_returnflag", "l_linestatus", "thirds", "mostly")
)
ALL_TESTS = f"""WITH chosen AS ({CHOSEN}), stats AS ({CORRELATION_STATS} UNION ALL {GROUP_STATS})
SELECT s.* FROM chosen c LEFT JOIN stats s ON s.col_a = c.col_a AND s.col_b = c.col_b
UNION ALL {CHI_STATS}"""


def flat(tests):
    return tests.select(
        "test_kind", "col_a", "col_b", "n", F.round("statistic", 4).alias("statistic"),
        F.round("effect_value", 4).alias("effect_value"),
    )


@query("significance_tests", ALL_TESTS)
def significance_tests(spark, sf_dir):
    return flat(_all_tests(spark, sf_dir))


# Upper tails by series and continued fraction, term by term. Every test is one row of `tails` (key, kind, a, b, x, y):
# `beta` is the regularised incomplete beta function I_x(a, b) with y = 1 - x, `gamma` the upper incomplete gamma function Q(a, x).
TAILS_SQL = """
turned AS (SELECT key, kind, kind = 'beta' AND x > (a + 1) / (a + b + 2) AS flip, a, b, x, y FROM tails),
ready AS (SELECT key, kind, flip, CASE WHEN flip THEN b ELSE a END AS p, CASE WHEN flip THEN a ELSE b END AS q,
  CASE WHEN flip THEN y ELSE x END AS z, CASE WHEN flip THEN x ELSE y END AS rest, kind = 'gamma' AND x < a + 1 AS low FROM turned),
-- modified Lentz for fractions, the plain series (value, term) for low gammas
steps AS (
  SELECT key, kind, low, p, q, z, 0 AS i, CASE WHEN low THEN 1 / p ELSE 1e-300 END AS value, CASE WHEN low THEN 1 / p ELSE 1e-300 END AS c, 0::DOUBLE AS d, false AS done FROM ready
  UNION ALL
  SELECT key, kind, low, p, q, z, i + 1, CASE WHEN low THEN value + c * z / (p + i + 1) ELSE value * c2 * d2 END,
    CASE WHEN low THEN c * z / (p + i + 1) ELSE c2 END, d2,
    CASE WHEN low THEN c * z / (p + i + 1) <= value * 1e-16 ELSE abs(c2 * d2 - 1) < 1e-15 END FROM (
    SELECT *, 1 / (one + top * d) AS d2, one + top / c AS c2 FROM (
      SELECT *, CASE WHEN kind = 'gamma' THEN z + 2 * (i + 1) - 1 - p ELSE 1 END AS one,
        CASE WHEN i = 0 THEN 1
          WHEN kind = 'gamma' THEN -i * (i - p)
          WHEN i % 2 = 0 THEN (i // 2) * (q - i // 2) * z / ((p + i - 1) * (p + i))
          ELSE -(p + i // 2) * (p + q + i // 2) * z / ((p + 2 * (i // 2)) * (p + 2 * (i // 2) + 1)) END AS top
      FROM steps WHERE NOT done AND i < 20000))
),
ended AS (SELECT key, arg_max(value, i) AS value FROM steps GROUP BY key),
tail AS (SELECT key, CASE
  WHEN kind = 'gamma' AND z <= 0 THEN 1.0
  WHEN kind = 'gamma' AND low THEN 1 - exp(p * ln(z) - z - lgamma(p)) * value
  WHEN kind = 'gamma' THEN exp(p * ln(z) - z - lgamma(p)) * value
  WHEN z <= 0 THEN flip::INT::DOUBLE
  WHEN flip THEN 1 - exp(p * ln(z) + q * ln(rest) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * value
  ELSE exp(p * ln(z) + q * ln(rest) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * value END AS p_value
  FROM ready JOIN ended USING (key))"""
# a t or F statistic as the x of a beta tail, a chi-square as that of a gamma tail
TAIL_ROWS = """tails AS (SELECT key, CASE WHEN tail = 'chi2' THEN 'gamma' ELSE 'beta' END AS kind,
  CASE tail WHEN 't' THEN dof1 / 2 WHEN 'f' THEN dof2 / 2 ELSE dof1 / 2 END AS a, CASE tail WHEN 't' THEN 0.5 WHEN 'f' THEN dof1 / 2 END AS b,
  CASE tail WHEN 't' THEN dof1 / (dof1 + s * s) WHEN 'f' THEN dof2 / (dof2 + dof1 * s) ELSE s / 2 END AS x,
  CASE tail WHEN 't' THEN s * s / (dof1 + s * s) WHEN 'f' THEN dof1 * s / (dof2 + dof1 * s) END AS y FROM given)"""


@query(
    "tail_probabilities",
    f"""WITH RECURSIVE o AS (SELECT o_orderkey AS key, (o_orderkey % 3)::INT AS m, 1 + o_orderkey % 997 AS d, 1 + o_custkey % 61 AS e,
  o_totalprice / 40000 AS v FROM orders),
given AS (SELECT key, CASE m WHEN 0 THEN 't' WHEN 1 THEN 'f' ELSE 'chi2' END AS tail,
  (CASE m WHEN 1 THEN e ELSE d END)::DOUBLE AS dof1, (CASE m WHEN 1 THEN d END)::DOUBLE AS dof2, (CASE m WHEN 2 THEN d * v / 4 ELSE v END)::DOUBLE AS s FROM o),
{TAIL_ROWS}, {TAILS_SQL} SELECT given.key, given.tail, round(p_value, 9) AS p_value FROM given JOIN tail USING (key)""",
)
def tail_probabilities(spark, sf_dir):
    """A statistic from every order: t, F and chi-square with 1 to 997 degrees of freedom."""
    key = F.col("o_orderkey")
    d, e, v, m = (1 + key % 997).cast("double"), (1 + F.col("o_custkey") % 61).cast("double"), F.col("o_totalprice") / 40000, key % 3
    given = ORDERS.read(spark, sf_dir).select(
        key.alias("key"), F.when(m == 0, "t").when(m == 1, "f").otherwise("chi2").alias("tail"), F.when(m == 1, e).otherwise(d).alias("dof1"),
        F.when(m == 1, d).alias("dof2"), F.when(m == 2, d * v / 4).otherwise(v).alias("s"),
    )
    return given.select("key", "tail", F.round(tail_probability(F.col("tail"), F.col("s"), F.col("dof1"), F.col("dof2")), 9).alias("p_value"))


@query("p_values_and_verdicts")
def p_values(spark, sf_dir):
    return _all_tests(spark, sf_dir)


@query("target_chi_square_tests", " UNION ALL ".join(chi_square_sql(PLANTED, a, "halves") for a in ("l_returnflag", "l_linestatus", "thirds", "mostly")))
def target_chi_square(spark, sf_dir):
    df = PLANTED.read(spark, sf_dir)
    pairs = significance.target_pairs(Profile.of(df), "halves")
    return significance.with_p_values(significance.chi_square_tests(df, pairs)).select(*chi_columns())


@query("strongest_significant_effect")
def strongest(spark, sf_dir):
    return significance.strongest_effect(_all_tests(spark, sf_dir))


@query("significant_tests")
def significant(spark, sf_dir):
    return significance.significant_tests(_all_tests(spark, sf_dir))


@query("tests_of_one_kind", CHI_STATS)
def one_kind(spark, sf_dir):
    return flat(significance.tests_of_kind(_all_tests(spark, sf_dir), "chi_square"))
