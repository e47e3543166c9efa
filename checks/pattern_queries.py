"""Correlations, group differences and the findings drawn from them."""

from pyspark.sql import functions as F

from tablewright.operators import patterns
from tablewright.operators.profile import Profile

from .relations import DOCUMENTS, EVENTS, LINEITEM, PLANTED, Relation, average_rank_sql, levels_sql, numeric_pairs, profile_cte, query

NUMERIC = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net", "gap"]
GROUPS = ["l_returnflag", "l_linestatus", "halves", "thirds", "mostly"]
PLAIN = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

STRENGTH = "CASE WHEN score >= 0.7 THEN 'very_strong' WHEN score >= 0.5 THEN 'strong' WHEN score >= 0.3 THEN 'moderate' ELSE 'weak' END"


def pearson_sql(rel: Relation, pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"corr({a}, {b}) AS r FROM {rel.sql}"
        for a, b in pairs
    )


def spearman_sql(rel: Relation, pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(x, y) AS rho FROM (SELECT {average_rank_sql(a)} AS x, "
        f"{average_rank_sql(b)} AS y FROM {rel.sql} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        for a, b in pairs
    )


PAIRS = numeric_pairs(NUMERIC)


@query("pearson_pairs", f"SELECT col_a, col_b, n, round(r, 4) AS pearson_r FROM ({pearson_sql(PLANTED, PAIRS)})")
def pearson_pairs(spark, sf_dir):
    found = patterns.pearson(PLANTED.read(spark, sf_dir), PAIRS)
    return found.select("col_a", "col_b", "n", F.round("pearson_r", 4).alias("pearson_r"))


@query("spearman_pairs", f"SELECT col_a, col_b, round(rho, 4) AS spearman_r FROM ({spearman_sql(LINEITEM, numeric_pairs(PLAIN))})")
def spearman_pairs(spark, sf_dir):
    found = patterns.spearman(LINEITEM.read(spark, sf_dir), numeric_pairs(PLAIN))
    return found.select("col_a", "col_b", F.round("spearman_r", 4).alias("spearman_r"))


@query(
    "spearman_pairs_with_gaps",
    f"SELECT col_a, col_b, round(rho, 4) AS spearman_r FROM ({spearman_sql(PLANTED, [(c, 'gap') for c in NUMERIC[:-1]])})",
)
def spearman_with_gaps(spark, sf_dir):
    found = patterns.spearman(PLANTED.read(spark, sf_dir), [(c, "gap") for c in NUMERIC[:-1]])
    return found.select("col_a", "col_b", F.round("spearman_r", 4).alias("spearman_r"))


# two columns miss the same rows, the third others
GAPS = Relation(
    "lineitem", ["l_quantity"],
    {
        "price": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END", "d"),
        "discount": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d"),
        "tax": ("CASE WHEN l_linenumber IN (2, 5) THEN NULL ELSE l_tax END", "d"),
    },
)
GAP_PAIRS = patterns.all_pairs(["l_quantity", "price", "discount", "tax"])


@query("spearman_pairs_shared_gaps", f"SELECT col_a, col_b, round(rho, 4) AS spearman_r FROM ({spearman_sql(GAPS, GAP_PAIRS)})")
def spearman_shared_gaps(spark, sf_dir):
    found = patterns.spearman(GAPS.read(spark, sf_dir), GAP_PAIRS)
    return found.select("col_a", "col_b", F.round("spearman_r", 4).alias("spearman_r"))


CORRELATIONS = f"""pears AS ({pearson_sql(PLANTED, PAIRS)}), spear AS ({spearman_sql(PLANTED, PAIRS)}),
both_r AS (SELECT p.*, s.rho, greatest(abs(p.r), abs(s.rho)) AS raw FROM pears p JOIN spear s USING (col_a, col_b)),
correlation_f AS (SELECT 'correlation' AS finding_type, col_a, col_b, round(raw, 4) AS score, raw,
  CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, round(r, 4) AS pearson_r, round(rho, 4) AS spearman_r,
  abs(rho) - abs(r) >= 0.2 AS nonlinear FROM both_r WHERE raw >= 0.3)"""


@query(
    "correlation_findings",
    f"""WITH {CORRELATIONS} SELECT finding_type, col_a, col_b, score, {STRENGTH.replace('score', 'raw')} AS strength, direction,
pearson_r, spearman_r, nonlinear FROM correlation_f""",
)
def correlation_findings(spark, sf_dir):
    found = patterns.correlation_findings(PLANTED.read(spark, sf_dir))
    return found.select(
        "finding_type", "col_a", "col_b", "score", "strength", "direction", "pearson_r", "spearman_r", "nonlinear"
    )


def group_means_sql(rel: Relation, measures, groups) -> str:
    return " UNION ALL ".join(
        f"SELECT '{g}' AS group_column, {g}::VARCHAR AS level, '{m}' AS measure, count(*) AS size, count({m}) AS n, "
        f"avg({m}) AS mean, var_samp({m}) AS variance FROM {rel.sql} WHERE {g} IS NOT NULL GROUP BY {g}"
        for g in groups for m in measures
    )


@query(
    "group_means",
    f"SELECT group_column, level, measure, size, n, round(mean, 4) AS mean, round(variance, 2) AS variance FROM ({group_means_sql(PLANTED, NUMERIC, GROUPS)})",
)
def group_means(spark, sf_dir):
    found = patterns.group_means(PLANTED.read(spark, sf_dir), NUMERIC, GROUPS)
    return found.withColumn("mean", F.round("mean", 4)).withColumn("variance", F.round("variance", 2))


def spread_cte(rel: Relation, measures, groups, name: str = "spread") -> str:
    overall = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, avg({m}) AS grand, stddev_samp({m}) AS std FROM {rel.sql}" for m in measures
    )
    return f"""{name}_means AS ({group_means_sql(rel, measures, groups)}), {name}_overall AS ({overall}),
{name} AS (SELECT measure, group_column, count(mean) AS n_groups,
  sqrt(sum(size * (mean - grand) * (mean - grand)) / sum(size)) / any_value(std) AS spread,
  first(level ORDER BY mean DESC, level) AS highest, first(level ORDER BY mean, level) AS lowest
  FROM {name}_means JOIN {name}_overall USING (measure) WHERE std > 0 GROUP BY measure, group_column HAVING count(mean) >= 2)"""


@query(
    "group_spread",
    f"WITH {spread_cte(PLANTED, NUMERIC, GROUPS)} SELECT measure, group_column, n_groups, round(spread, 4) AS spread, highest, lowest FROM spread",
)
def group_spread(spark, sf_dir):
    found = patterns.group_spread(PLANTED.read(spark, sf_dir), NUMERIC, GROUPS)
    return found.withColumn("spread", F.round("spread", 4))


GROUP_F = f"""{spread_cte(PLANTED, NUMERIC, GROUPS)},
group_f AS (SELECT 'group_difference' AS finding_type, measure AS col_a, group_column AS col_b, least(1.0, round(spread, 4)) AS score,
  highest, lowest FROM spread WHERE least(1.0, round(spread, 4)) >= 0.3)"""


@query(
    "group_difference_findings",
    f"WITH {GROUP_F} SELECT finding_type, col_a, col_b, score, {STRENGTH} AS strength, highest, lowest FROM group_f",
)
def group_difference_findings(spark, sf_dir):
    found = patterns.group_difference_findings(PLANTED.read(spark, sf_dir))
    return found.select("finding_type", "col_a", "col_b", "score", "strength", "highest", "lowest")


TARGET_NUMERIC = [(c, "net") for c in NUMERIC if c != "net"]
# the target sits between the other columns; a pair is written (feature, target)
@query(
    "target_findings_numeric",
    f"""SELECT 'target_relationship' AS finding_type, col_a, col_b, round(abs(rho), 4) AS score,
CASE WHEN rho >= 0 THEN 'positive' ELSE 'negative' END AS direction, round(rho, 4) AS spearman_r
FROM ({spearman_sql(PLANTED, TARGET_NUMERIC)}) WHERE abs(rho) >= 0.25""",
)
def target_numeric(spark, sf_dir):
    found = patterns.target_findings(PLANTED.read(spark, sf_dir), "net")
    return found.select("finding_type", "col_a", "col_b", "score", "direction", "spearman_r")


@query(
    "target_findings_classes",
    f"""WITH {spread_cte(PLANTED, NUMERIC, ['thirds'])} SELECT 'target_relationship' AS finding_type, measure AS col_a,
group_column AS col_b, least(1.0, round(spread, 4)) AS score, highest, lowest FROM spread WHERE least(1.0, round(spread, 4)) >= 0.25""",
)
def target_classes(spark, sf_dir):
    found = patterns.target_findings(PLANTED.read(spark, sf_dir), "thirds")
    return found.select("finding_type", "col_a", "col_b", "score", "highest", "lowest")


def skew_f(rel: Relation) -> str:
    return f"""SELECT 'distribution_skew' AS finding_type, col AS col_a, round(least(1.0, abs(round(skew, 4)) / 3.0), 4) AS score,
CASE WHEN skew > 0 THEN 'right' ELSE 'left' END AS direction, round(skew, 4) AS skew FROM profile
WHERE semantic_type IN ('numeric_continuous', 'numeric_discrete') AND abs(round(skew, 4)) >= 1.0"""


def register_skew(name: str, rel: Relation):
    @query(f"skew_findings_{name}", f"WITH {profile_cte(rel)} SELECT *, {STRENGTH} AS strength FROM ({skew_f(rel)})")
    def skewed(spark, sf_dir):
        found = patterns.skew_findings(Profile.of(rel.read(spark, sf_dir)).frame)
        return found.select("finding_type", "col_a", "score", "direction", "skew", "strength")


register_skew("documents", DOCUMENTS)
register_skew("events", EVENTS)

DOMINANT = f"""dominant_levels AS ({levels_sql(PLANTED, GROUPS)}),
dominant_share AS (SELECT col, first(value ORDER BY n DESC, value) AS top_level, max(n) * 100.0 / sum(n) AS top_pct FROM dominant_levels GROUP BY col),
dominant_f AS (SELECT 'dominant_category' AS finding_type, col AS col_a, round(least(1.0, (top_pct - 50.0) / 50.0), 4) AS score,
  top_level, round(top_pct, 2) AS top_pct FROM dominant_share WHERE top_pct >= 90.0)"""


@query("dominant_findings", f"WITH {DOMINANT} SELECT finding_type, col_a, score, top_level, top_pct, {STRENGTH} AS strength FROM dominant_f")
def dominant_findings(spark, sf_dir):
    found = patterns.dominant_findings(Profile.of(PLANTED.read(spark, sf_dir)).frame)
    return found.select("finding_type", "col_a", "score", "top_level", "top_pct", "strength")


ALL_FINDINGS = f"""{CORRELATIONS}, {GROUP_F}, {DOMINANT}, {profile_cte(PLANTED)},
target_f AS (SELECT 'target_relationship' AS finding_type, measure AS col_a, group_column AS col_b, least(1.0, round(spread, 4)) AS score
  FROM spread WHERE group_column = 'halves' AND least(1.0, round(spread, 4)) >= 0.25),
found AS (
  SELECT 0 AS detector, finding_type, col_a, col_b, score FROM correlation_f UNION ALL
  SELECT 1, finding_type, col_a, col_b, score FROM group_f UNION ALL
  SELECT 2, finding_type, col_a, NULL, score FROM ({skew_f(PLANTED)}) UNION ALL
  SELECT 3, finding_type, col_a, NULL, score FROM dominant_f UNION ALL
  SELECT 4, finding_type, col_a, col_b, score FROM target_f)"""


@query("ranked_findings", f"WITH {ALL_FINDINGS} SELECT finding_type, col_a, col_b, score FROM found")
def ranked_findings(spark, sf_dir):
    return patterns.findings(PLANTED.read(spark, sf_dir), "halves").select("finding_type", "col_a", "col_b", "score")


@query(
    "top_findings",
    f"""WITH {ALL_FINDINGS}, ordered AS (SELECT f.*, a.position AS pa, b.position AS pb FROM found f
  JOIN profile a ON a.col = f.col_a LEFT JOIN profile b ON b.col = f.col_b)
SELECT finding_type, col_a, col_b, score FROM ordered
ORDER BY score DESC, detector, CASE WHEN detector = 1 THEN pb ELSE pa END, CASE WHEN detector = 1 THEN pa ELSE pb END LIMIT 3""",
)
def top_findings(spark, sf_dir):
    found = patterns.findings(PLANTED.read(spark, sf_dir), "halves")
    return patterns.top_findings(found, 3).select("finding_type", "col_a", "col_b", "score")


@query("finding_counts", f"WITH {ALL_FINDINGS} SELECT finding_type, count(*) AS n_findings FROM found GROUP BY finding_type")
def finding_counts(spark, sf_dir):
    return patterns.finding_counts(patterns.findings(PLANTED.read(spark, sf_dir), "halves"))


@query("findings_of_one_type", f"WITH {ALL_FINDINGS} SELECT finding_type, col_a, col_b, score FROM found WHERE finding_type = 'group_difference'")
def findings_of_one_type(spark, sf_dir):
    found = patterns.findings(PLANTED.read(spark, sf_dir), "halves")
    return patterns.findings_of_type(found, "group_difference").select("finding_type", "col_a", "col_b", "score")
