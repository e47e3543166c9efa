"""Data quality issues, scores and grades."""

from pyspark.sql import functions as F

from tablewright.operators import health
from tablewright.operators.frequency import duplicate_rows
from tablewright.operators.profile import Profile

from .relations import DOCUMENTS, EVENTS, LABELS, MESSY, PART, Relation, levels_sql, pct, profile_cte, query

SEVERITY_WEIGHT_SQL = (
    "CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 6.0 WHEN 'low' THEN 2.0 ELSE 0.0 END"
)
SEVERITY_RANK_SQL = (
    "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
)


def issues_cte(rel: Relation) -> str:
    """CTEs ending in `issues` with the evidence every engine agrees on."""
    labels = [c for c, t in rel.types.items() if t == "s"]
    numbers = [c for c, t in rel.types.items() if t == "d" or t == "i"]
    levels = levels_sql(rel, labels) if labels else "SELECT ''::VARCHAR AS col, ''::VARCHAR AS value, 0::BIGINT AS n WHERE false"
    outliers = " UNION ALL ".join(
        f"""SELECT p.position, p.col, p.n_present, p.q25 - 1.5 * (p.q75 - p.q25) AS lo, p.q75 + 1.5 * (p.q75 - p.q25) AS hi,
(SELECT count(*) FROM {rel.sql} WHERE {c} < p.q25 - 1.5 * (p.q75 - p.q25) OR {c} > p.q75 + 1.5 * (p.q75 - p.q25)) AS n_out
FROM profile p WHERE p.col = '{c}' AND p.semantic_type = 'numeric_continuous' AND p.n_present >= 4 AND p.q75 > p.q25"""
        for c in numbers
    ) or "SELECT 0 AS position, '' AS col, 0 AS n_present, 0.0 AS lo, 0.0 AS hi, 0 AS n_out WHERE false"
    every = levels_sql(rel, [c for c, t in rel.types.items() if t not in "n"])
    keys = ", ".join(rel.types)
    return f"""{profile_cte(rel)},
levels AS ({levels}),
all_levels AS ({every}),
copies AS (SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_dup
  FROM (SELECT count(*) AS n FROM {rel.sql} GROUP BY {keys})),
outliers AS ({outliers}),
cat AS (SELECT p.position, l.* FROM levels l JOIN profile p ON p.col = l.col AND p.semantic_type = 'categorical'),
rare AS (SELECT position, col, count(*) AS n_rare FROM cat WHERE n <= 2 GROUP BY position, col),
minority AS (SELECT p.position, p.col, min(l.n) AS least, {pct('min(l.n)', 'sum(l.n)::BIGINT')} AS minority_pct
  FROM all_levels l JOIN profile p ON p.col = l.col AND p.semantic_type = 'binary' GROUP BY p.position, p.col),
spelled AS (SELECT position, col, count(*) AS raw, count(DISTINCT lower(trim(value))) AS clean FROM cat GROUP BY position, col),
issues AS (
  SELECT 0 AS check_order, 'missing_values' AS category,
    CASE WHEN missing_pct >= 60 THEN 'critical' WHEN missing_pct >= 30 THEN 'high' WHEN missing_pct >= 5 THEN 'medium' ELSE 'low' END AS severity,
    position AS column_order, col, n_missing AS n_affected, missing_pct AS pct,
    CASE WHEN missing_pct >= 60 THEN 'drop_column'
         WHEN semantic_type = 'numeric_continuous' AND abs(round(skew, 4)) > 1 THEN 'fill_median'
         WHEN semantic_type = 'numeric_continuous' THEN 'fill_mean_or_median'
         WHEN semantic_type IN ('categorical', 'binary', 'numeric_discrete') THEN 'fill_mode' ELSE 'review' END AS advice
  FROM profile WHERE n_missing > 0
  UNION ALL SELECT 1, 'duplicate_rows', CASE WHEN {pct('n_dup', 'n_rows')} >= 10 THEN 'high' ELSE 'medium' END, -1, NULL, n_dup,
    {pct('n_dup', 'n_rows')}, 'review_duplicates' FROM copies WHERE n_dup > 0
  UNION ALL SELECT 2, 'constant_column', 'medium', position, col, NULL, NULL, 'drop_column' FROM profile WHERE semantic_type = 'constant'
  UNION ALL SELECT 3, 'outliers', CASE WHEN {pct('n_out', 'n_present')} >= 5 THEN 'medium' ELSE 'low' END, position, col, n_out,
    {pct('n_out', 'n_present')}, 'inspect_extremes' FROM outliers WHERE n_out > 0
  UNION ALL SELECT 4, 'high_cardinality', 'medium', position, col, NULL, unique_pct, 'group_or_frequency_encode'
    FROM profile WHERE semantic_type = 'categorical' AND n_unique >= 50
  UNION ALL SELECT 5, 'rare_category', 'low', position, col, NULL, NULL, 'group_rare' FROM rare
  UNION ALL SELECT 6, 'class_imbalance', CASE WHEN minority_pct < 10 THEN 'high' ELSE 'medium' END, position, col, least,
    minority_pct, 'use_f1_or_resample' FROM minority WHERE minority_pct < 25
  UNION ALL SELECT 7, 'inconsistent_values', 'medium', position, col, raw - clean, NULL, 'standardise_labels'
    FROM spelled WHERE clean < raw
)"""


ISSUE_COLUMNS = ["check_order", "category", "severity", "column_order", "column", "n_affected", "pct", "advice"]
ISSUE_SQL = 'check_order, category, severity, column_order, col AS "column", n_affected, pct, advice'


def register_issues(name: str, rel: Relation):
    @query(f"health_issues_{name}", f"WITH {issues_cte(rel)} SELECT {ISSUE_SQL} FROM issues")
    def issues(spark, sf_dir):
        return health.health_issues(rel.read(spark, sf_dir)).select(*ISSUE_COLUMNS)


SCORE_SQL = f"""SELECT greatest(0.0, round(100.0 - coalesce(sum({SEVERITY_WEIGHT_SQL}), 0.0), 1))::DOUBLE AS score, count(*) AS n_issues
FROM issues"""
GRADE_SQL = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END"

for _name, _rel in [("messy_lineitem", MESSY), ("events", EVENTS), ("documents", DOCUMENTS), ("labels", LABELS), ("part", PART)]:
    register_issues(_name, _rel)


def one_check(name: str, rel: Relation, order: int):
    @query(name, f"WITH {issues_cte(rel)} SELECT {ISSUE_SQL} FROM issues WHERE check_order = {order}")
    def run(spark, sf_dir):
        df = rel.read(spark, sf_dir)
        if order == 1:
            found = health.duplicate_issues(duplicate_rows(df))
        else:
            p = Profile.of(df)
            categories = p.columns("categorical")
            if order == 0:
                found = health.missing_issues(p.frame)
            elif order == 2:
                found = health.constant_issues(p.frame)
            elif order == 3:
                found = health.outlier_issues(health.outlier_table(df, p))
            elif order == 4:
                found = health.cardinality_issues(p.frame)
            elif order == 5:
                counts = health.label_counts(df, categories)
                levels = health.level_summary(df, categories, p.n_rows, counts=counts)
                found = health.rare_issues(levels, health.rare_examples(df, categories, counts=counts), p.frame)
            elif order == 6:
                found = health.imbalance_issues(p.frame)
            else:
                found = health.inconsistency_issues(health.level_summary(df, categories, p.n_rows), p.frame)
        return found.select(*ISSUE_COLUMNS)


DUPLICATED = Relation("lineitem", ["l_linenumber", "l_returnflag", "l_linestatus", "l_tax"])
one_check("missing_value_issues", MESSY, 0)
one_check("duplicate_row_issues", DUPLICATED, 1)
one_check("constant_column_issues", MESSY, 2)
one_check("outlier_issues", EVENTS, 3)
one_check("high_cardinality_issues", PART, 4)
one_check("rare_category_issues", MESSY, 5)
one_check("class_imbalance_issues", LABELS, 6)
one_check("inconsistent_label_issues", MESSY, 7)


@query(
    "outlier_fences",
    f"""WITH {issues_cte(DOCUMENTS)} SELECT col AS "column", n_present AS n, round(lo, 4) AS lower_bound,
round(hi, 4) AS upper_bound, n_out AS n_outliers FROM outliers""",
)
def outlier_fences(spark, sf_dir):
    df = DOCUMENTS.read(spark, sf_dir)
    return health.outlier_table(df, Profile.of(df)).select(
        "column", "n", F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"), "n_outliers"
    )


@query(
    "rare_category_examples",
    f"""WITH {issues_cte(MESSY)}, r AS (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place FROM cat WHERE n <= 2)
SELECT col AS "column", string_agg(value, '|' ORDER BY place) AS examples FROM r WHERE place <= 5 GROUP BY col""",
)
def rare_examples(spark, sf_dir):
    df = MESSY.read(spark, sf_dir)
    found = health.rare_examples(df, Profile.of(df).columns("categorical"))
    return found.select("column", F.array_join("examples", "|").alias("examples"))


@query(
    "level_summary",
    f"""WITH {issues_cte(MESSY)} SELECT col AS "column", count(*) AS raw_levels,
count(DISTINCT lower(trim(value))) AS normal_levels, count(*) FILTER (WHERE n <= 2) AS n_rare,
count(*) FILTER (WHERE n::DOUBLE / (SELECT count(*) FROM lineitem) < 0.02) AS n_small FROM cat GROUP BY col""",
)
def level_summary(spark, sf_dir):
    df = MESSY.read(spark, sf_dir)
    p = Profile.of(df)
    return health.level_summary(df, p.columns("categorical"), p.n_rows)


@query(
    "health_issue_order",
    f"""WITH {issues_cte(MESSY)} SELECT row_number() OVER (ORDER BY {SEVERITY_RANK_SQL}, check_order, column_order) AS place,
category, col AS "column", severity FROM issues""",
)
def issue_order(spark, sf_dir):
    from pyspark.sql import Window

    found = health.health_issues(MESSY.read(spark, sf_dir))
    # issues are at most a few per column
    place = F.row_number().over(Window.orderBy("severity_rank", "check_order", "column_order"))
    return found.select(place.alias("place"), "category", "column", "severity")


@query("health_score", f"WITH {issues_cte(MESSY)}, s AS ({SCORE_SQL}) SELECT score, {GRADE_SQL} AS grade, n_issues FROM s")
def health_score(spark, sf_dir):
    return health.health_score(health.health_issues(MESSY.read(spark, sf_dir)))


@query(
    "health_grades",
    " UNION ALL ".join(
        f"(WITH {issues_cte(r)}, s AS ({SCORE_SQL}) SELECT '{r.table}' AS source, {GRADE_SQL} AS grade FROM s)"
        for r in (EVENTS, LABELS, PART)
    ),
)
def health_grades(spark, sf_dir):
    from tablewright.operators.frequency import union_all

    return union_all(
        [
            health.health_score(health.health_issues(r.read(spark, sf_dir))).select(F.lit(r.table).alias("source"), "grade")
            for r in (EVENTS, LABELS, PART)
        ]
    )


@query("issues_by_severity", f"WITH {issues_cte(MESSY)} SELECT severity, count(*) AS n_issues FROM issues GROUP BY severity")
def issues_by_severity(spark, sf_dir):
    return health.issues_by_severity(health.health_issues(MESSY.read(spark, sf_dir)))


@query(
    "most_urgent_issue",
    f"""WITH {issues_cte(MESSY)} SELECT category, col AS "column", severity, advice FROM issues
ORDER BY {SEVERITY_RANK_SQL}, check_order, column_order LIMIT 1""",
)
def most_urgent(spark, sf_dir):
    return health.most_urgent_issue(health.health_issues(MESSY.read(spark, sf_dir))).select(
        "category", "column", "severity", "advice"
    )


@query(
    "quality_dimensions",
    f"""WITH {issues_cte(MESSY)}, dims(dimension) AS (VALUES ('completeness'), ('consistency'), ('validity'), ('uniqueness'), ('distribution')),
lost AS (SELECT CASE WHEN category = 'missing_values' THEN 'completeness' WHEN category IN ('inconsistent_values', 'rare_category') THEN 'consistency'
  WHEN category IN ('constant_column', 'class_imbalance') THEN 'validity' WHEN category IN ('duplicate_rows', 'high_cardinality') THEN 'uniqueness'
  ELSE 'distribution' END AS dimension, sum(1.5 * {SEVERITY_WEIGHT_SQL}) AS lost FROM issues GROUP BY 1)
SELECT d.dimension, floor(greatest(0.0, 100.0 - coalesce(l.lost, 0.0)) + 0.5)::BIGINT AS score FROM dims d LEFT JOIN lost l USING (dimension)""",
)
def quality_dimensions(spark, sf_dir):
    return health.quality_dimensions(health.health_issues(MESSY.read(spark, sf_dir)))


DEDUPED = Relation("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], {"fixed": ("'x'", "s"), "gap": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d")})
DROPPED = Relation("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], {"gap": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d")})


@query(
    "health_change",
    f"""SELECT b.score AS score_before, b.grade AS grade_before, a.score AS score_after, a.grade AS grade_after,
round(a.score - b.score, 1) AS delta FROM
(WITH {issues_cte(DEDUPED)}, s AS ({SCORE_SQL}) SELECT score, {GRADE_SQL} AS grade FROM s) b,
(WITH {issues_cte(DROPPED)}, s AS ({SCORE_SQL}) SELECT score, {GRADE_SQL} AS grade FROM s) a""",
)
def health_change(spark, sf_dir):
    from tablewright.operators.transforms import apply_transform

    before = DEDUPED.read(spark, sf_dir)
    after = apply_transform(before, "drop_column", ["fixed"])
    return health.health_change(health.health_issues(before), health.health_issues(after))


@query(
    "filtered_issues",
    f"""WITH {issues_cte(MESSY)} SELECT category, severity, col AS "column" FROM issues
WHERE severity = 'medium' AND category = 'missing_values'""",
)
def filtered_issues(spark, sf_dir):
    found = health.health_issues(MESSY.read(spark, sf_dir))
    return health.filter_issues(found, severity="medium", category="missing_values").select("category", "severity", "column")
