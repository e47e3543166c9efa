"""Feature suggestions."""

from pyspark.sql import functions as F

from tablewright.operators import suggestions
from tablewright.operators.health import level_summary, outlier_table
from tablewright.operators.profile import Profile

from .health_queries import issues_cte
from .relations import DOCUMENTS, EVENTS, LINEITEM, MESSY, ORDERS, PART, Relation, levels_sql, query

COLUMNS = ["transform", "columns", "priority"]


def suggestions_cte(rel: Relation) -> str:
    """CTEs ending in `made`: detector, place, transform, columns (joined by commas), priority."""
    all_cols = levels_sql(rel, [c for c, t in rel.types.items() if t != "n"])
    n_rows = f"(SELECT count(*) FROM {rel.sql})"
    return f"""{issues_cte(rel)},
flag_levels AS ({all_cols}),
zero_one AS (SELECT p.col, bool_and(lower(l.value) IN ('0', '1', '0.0', '1.0')) AS done FROM profile p JOIN flag_levels l ON l.col = p.col
  WHERE p.semantic_type = 'binary' GROUP BY p.col),
stds AS (SELECT col, position, round(std, 4) AS std FROM profile
  WHERE semantic_type IN ('numeric_continuous', 'numeric_discrete') AND round(std, 4) > 0),
small AS (SELECT position, col, count(*) AS n_small FROM cat WHERE n::DOUBLE / {n_rows} < 0.02 GROUP BY position, col),
made AS (
  SELECT 0 AS detector, CASE semantic_type WHEN 'identifier' THEN 0 WHEN 'constant' THEN 100000 ELSE 200000 END + position AS place,
    CASE WHEN semantic_type = 'text' THEN 'text_feature' ELSE 'drop_column' END AS transform, col AS columns,
    CASE WHEN semantic_type = 'text' THEN 'optional' ELSE 'essential' END AS priority
  FROM profile WHERE semantic_type IN ('identifier', 'constant', 'text')
  UNION ALL SELECT 1, position, CASE WHEN n_unique <= 15 THEN 'one_hot_encode' ELSE 'frequency_encode' END, col,
    CASE WHEN n_unique <= 15 THEN 'essential' ELSE 'recommended' END FROM profile WHERE semantic_type = 'categorical'
  UNION ALL SELECT 1, 100000 + p.position, 'ordinal_encode', p.col, 'essential' FROM profile p JOIN zero_one z ON z.col = p.col AND NOT z.done
  UNION ALL SELECT 2, position, CASE WHEN round(skew, 4) >= 2 THEN 'log_transform' ELSE 'sqrt_transform' END, col,
    CASE WHEN round(skew, 4) >= 2 THEN 'recommended' ELSE 'optional' END
    FROM profile WHERE semantic_type = 'numeric_continuous' AND abs(round(skew, 4)) >= 1 AND min >= 0
  UNION ALL SELECT 3, 0, 'standard_scale', string_agg(col, ',' ORDER BY position), 'recommended' FROM stds
    HAVING count(*) >= 2 AND max(std) / min(std) >= 10
  UNION ALL SELECT 4, position, 'clip_outliers', col, 'optional' FROM outliers WHERE n_present >= 10 AND n_out * 100.0 / n_present >= 1.0
  UNION ALL SELECT 5, position, 'group_rare', col, 'optional' FROM small WHERE n_small >= 2
  UNION ALL SELECT 6, position, 'extract_datetime_parts', col, 'recommended' FROM profile WHERE semantic_type = 'datetime'
)"""


def flat(found):
    return found.select("transform", F.array_join("columns", ",").alias("columns"), "priority")


def register(name: str, rel: Relation):
    @query(f"feature_suggestions_{name}", f"WITH {suggestions_cte(rel)} SELECT transform, columns, priority FROM made")
    def run(spark, sf_dir):
        return flat(suggestions.feature_suggestions(rel.read(spark, sf_dir)))


for _name, _rel in [("messy_lineitem", MESSY), ("events", EVENTS), ("documents", DOCUMENTS), ("part", PART), ("orders", ORDERS)]:
    register(_name, _rel)


def one_detector(name: str, rel: Relation, detector: int):
    @query(name, f"WITH {suggestions_cte(rel)} SELECT transform, columns, priority FROM made WHERE detector = {detector}")
    def run(spark, sf_dir):
        df = rel.read(spark, sf_dir)
        p = Profile.of(df)
        if detector == 4:
            found = suggestions.clipping_suggestions(outlier_table(df, p))
        elif detector == 5:
            found = suggestions.rare_label_suggestions(level_summary(df, p.columns("categorical"), p.n_rows), p.frame)
        else:
            found = {
                0: suggestions.drop_suggestions, 1: suggestions.encoding_suggestions, 2: suggestions.skew_suggestions,
                3: suggestions.scaling_suggestions, 6: suggestions.date_suggestions,
            }[detector](p.frame)
        return flat(found)


one_detector("drop_suggestions", DOCUMENTS, 0)
one_detector("encoding_suggestions", PART, 1)
one_detector("skew_suggestions", EVENTS, 2)
one_detector("scaling_suggestions", LINEITEM, 3)
one_detector("clipping_suggestions", DOCUMENTS, 4)
one_detector("rare_label_suggestions", EVENTS, 5)
one_detector("date_suggestions", ORDERS, 6)


@query(
    "suggestions_without_target",
    f"WITH {suggestions_cte(EVENTS)} SELECT transform, columns, priority FROM made WHERE columns <> 'event_type'",
)
def without_target(spark, sf_dir):
    return flat(suggestions.feature_suggestions(EVENTS.read(spark, sf_dir), target="event_type"))


@query(
    "ranked_suggestions",
    f"""WITH {suggestions_cte(EVENTS)} SELECT row_number() OVER (ORDER BY CASE priority WHEN 'essential' THEN 3 WHEN 'recommended' THEN 2 ELSE 1 END DESC,
detector, place) AS place, transform, columns FROM made""",
)
def ranked(spark, sf_dir):
    from pyspark.sql import Window

    found = suggestions.feature_suggestions(EVENTS.read(spark, sf_dir))
    weight = F.when(F.col("priority") == "essential", 3).when(F.col("priority") == "recommended", 2).otherwise(1)
    # a few suggestions per column
    place = F.row_number().over(Window.orderBy(weight.desc(), "detector", "column_order"))
    return found.select(place.alias("place"), "transform", F.array_join("columns", ",").alias("columns"))


@query(
    "suggestions_by_priority",
    f"WITH {suggestions_cte(EVENTS)} SELECT priority, count(*) AS n_suggestions FROM made GROUP BY priority",
)
def by_priority(spark, sf_dir):
    return suggestions.suggestions_by_priority(suggestions.feature_suggestions(EVENTS.read(spark, sf_dir)))
