"""Column profiles and what is read off them."""

from pyspark.sql import functions as F

from tablewright.operators import frequency, ordering, profile
from tablewright.sources.tables import table_shape

from .relations import (
    CUSTOMER,
    DOCUMENTS,
    EVENTS,
    LABELS,
    LINEITEM,
    MESSY,
    ORDERS,
    PART,
    Relation,
    levels_sql,
    profile_cte,
    query,
)

PROFILE_COLUMNS = [
    "position", "column", "semantic_type", "n_total", "n_missing", "missing_pct", "n_unique", "unique_pct", "min", "max",
    "mean", "median", "std", "q25", "q75", "skew", "avg_char_length", "earliest", "latest",
]


def profile_select_sql(rel: Relation) -> str:
    measured = "kind IN ('i', 'd') AND semantic_type IN ('identifier', 'numeric_discrete', 'numeric_continuous')"

    def stat(e: str) -> str:
        return f"CASE WHEN {measured} THEN {e} END"

    return f"""WITH {profile_cte(rel)}
SELECT position, col AS "column", semantic_type, n_total, n_missing, missing_pct, n_unique, unique_pct,
  {stat('min')} AS min, {stat('max')} AS max, {stat('round(mean, 4)')} AS mean, {stat('round(q50, 4)')} AS median,
  {stat('round(coalesce(std, 0.0), 4)')} AS std, {stat('round(q25, 4)')} AS q25, {stat('round(q75, 4)')} AS q75,
  {stat('CASE WHEN round(skew, 4) = 0 THEN 0.0::DOUBLE ELSE round(skew, 4) END')} AS skew,
  CASE WHEN kind = 's' AND semantic_type IN ('identifier', 'text') THEN round(avg_length, 1) END AS avg_char_length,
  CASE WHEN semantic_type = 'datetime' THEN earliest END AS earliest,
  CASE WHEN semantic_type = 'datetime' THEN latest END AS latest
FROM profile"""


def register_profile(name: str, rel: Relation):
    @query(f"column_profile_{name}", profile_select_sql(rel))
    def run(spark, sf_dir):
        return profile.column_profile(rel.read(spark, sf_dir)).select(*PROFILE_COLUMNS)


for _name, _rel in [
    ("lineitem", LINEITEM), ("orders", ORDERS), ("customer", CUSTOMER), ("part", PART), ("events", EVENTS),
    ("documents", DOCUMENTS), ("labels", LABELS), ("messy_lineitem", MESSY), ("embeddings", Relation("embeddings")),
    ("conversations", Relation("conversations")), ("pages", Relation("pages")), ("nation", Relation("nation")),
    ("supplier", Relation("supplier")),
]:
    register_profile(_name, _rel)


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf_dir):
    return table_shape(LINEITEM.read(spark, sf_dir))


@query(
    "missing_counts",
    f"""WITH {profile_cte(MESSY)} SELECT col AS "column", n_total, n_missing, missing_pct FROM profile""",
)
def missing_counts(spark, sf_dir):
    facts = profile.column_facts(MESSY.read(spark, sf_dir))
    missing = F.col("n_total") - F.col("n_present")
    return facts.select(
        "column", "n_total", missing.alias("n_missing"), profile.pct_of(missing, F.col("n_total")).alias("missing_pct")
    )


@query(
    "distinct_counts",
    f"""WITH {profile_cte(EVENTS)} SELECT col AS "column", n_unique FROM profile""",
)
def distinct_counts(spark, sf_dir):
    return frequency.distinct_counts(EVENTS.read(spark, sf_dir))


@query("approximate_distinct_counts")
def approximate_counts(spark, sf_dir):
    return frequency.approximate_distinct_counts(LINEITEM.read(spark, sf_dir), list(LINEITEM.types))


@query(
    "sample_values",
    "WITH v AS (" + levels_sql(PART, ["p_name", "p_brand", "p_type"]) + ")"
    """, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place FROM v)
SELECT col AS "column", string_agg(value, '|' ORDER BY place) AS sample_values FROM r WHERE place <= 5 GROUP BY col""",
)
def sample_values(spark, sf_dir):
    found = profile.column_profile(PART.read(spark, sf_dir))
    return found.where("semantic_type = 'categorical'").select(
        "column", F.array_join("sample_values", "|").alias("sample_values")
    )


NUMERIC_LINEITEM = [c for c, t in LINEITEM.types.items() if t in "id"]


def numeric_summary_sql(rel: Relation, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
round(avg({c}), 4) AS mean, round(median({c})::DOUBLE, 4) AS median, round(coalesce(stddev_samp({c}), 0.0), 4) AS std,
round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q75,
round(skewness({c}), 4) AS skew, bool_and({c} % 1 = 0) AS whole FROM {rel.sql}"""
        for c in columns
    )


@query("numeric_summary_lineitem", numeric_summary_sql(LINEITEM, NUMERIC_LINEITEM))
def numeric_summary_lineitem(spark, sf_dir):
    return profile.numeric_summary(LINEITEM.read(spark, sf_dir))


@query("numeric_summary_events", numeric_summary_sql(EVENTS, ["event_id", "user_id", "value"]))
def numeric_summary_events(spark, sf_dir):
    return profile.numeric_summary(EVENTS.read(spark, sf_dir))


@query(
    "exact_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, quantile_cont({c}, {p})::DOUBLE AS value FROM {MESSY.sql}"""
        for c in ("gap", "l_extendedprice", "price_level", "l_quantity") for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    ),
)
def exact_quantiles(spark, sf_dir):
    """The form for tables whose columns do not fit one task: sketch, count, narrow down."""
    wanted = [0.01, 0.25, 0.5, 0.75, 0.99]
    df = MESSY.read(spark, sf_dir)
    found = ordering.exact_quantiles(
        df, {c: wanted for c in ("gap", "l_extendedprice", "price_level", "l_quantity")}, gathered=50
    )
    return spark.createDataFrame(
        [(c, p, v) for c, values in found.items() for p, v in zip(wanted, values)], "column string, p double, value double"
    )


@query(
    "top_values",
    "WITH v AS (" + levels_sql(PART, ["p_name", "p_brand", "p_type"]) + ")"
    """, r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place FROM v)
SELECT col AS "column", place, value, n FROM r WHERE place <= 10""",
)
def top_values(spark, sf_dir):
    return profile.top_values(profile.column_profile(PART.read(spark, sf_dir)))


@query(
    "top_texts",
    """WITH r AS (SELECT text, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC,
    CASE WHEN length(text) > 64 THEN concat('sha256:', sha256(text)) ELSE text END) AS place
  FROM documents GROUP BY text)
SELECT 'text' AS "column", place, text AS value, n FROM r WHERE place <= 10""",
)
def top_texts(spark, sf_dir):
    """Long values are grouped by digest and spelled out in full at the end."""
    return frequency.leading_values_of(DOCUMENTS.read(spark, sf_dir), 10, ["text"])


@query(
    "time_ranges",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS source, min({c})::VARCHAR AS earliest, max({c})::VARCHAR AS latest FROM {t}"""
        for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))
    ),
)
def time_ranges(spark, sf_dir):
    parts = []
    for rel, c in ((LINEITEM, "l_shipdate"), (ORDERS, "o_orderdate"), (EVENTS, "ts")):
        facts = profile.column_facts(rel.read(spark, sf_dir).select(c))
        parts.append(facts.select(F.lit(rel.table).alias("source"), "earliest", "latest"))
    return frequency.union_all(parts)


@query(
    "text_lengths",
    f"""WITH {profile_cte(DOCUMENTS)} SELECT col AS "column", round(avg_length, 1) AS avg_char_length
FROM profile WHERE semantic_type IN ('identifier', 'text') AND kind = 's'""",
)
def text_lengths(spark, sf_dir):
    found = profile.column_profile(DOCUMENTS.read(spark, sf_dir))
    return found.where("avg_char_length IS NOT NULL").select("column", "avg_char_length")


FOUR = Relation("lineitem", ["l_linenumber", "l_returnflag", "l_linestatus", "l_tax"], {"gap": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d")})


def duplicates_sql(rel: Relation) -> str:
    keys = ", ".join(rel.types)
    return f"""WITH g AS (SELECT count(*) AS n FROM {rel.sql} GROUP BY {keys})
SELECT sum(n)::BIGINT AS n_rows, {len(rel.types)} AS n_cols, sum(n - 1)::BIGINT AS n_duplicate_rows FROM g"""


@query("duplicate_rows_lineitem", duplicates_sql(FOUR))
def duplicate_rows_lineitem(spark, sf_dir):
    return profile.dataset_profile(FOUR.read(spark, sf_dir))


TEXTS = Relation("documents", ["text", "lang"])


@query("duplicate_rows_documents", duplicates_sql(TEXTS))
def duplicate_rows_documents(spark, sf_dir):
    return profile.dataset_profile(TEXTS.read(spark, sf_dir))


@query(
    "column_makeup",
    f"WITH {profile_cte(MESSY)} SELECT semantic_type, count(*) AS n_columns FROM profile GROUP BY semantic_type",
)
def column_makeup(spark, sf_dir):
    return profile.column_makeup(profile.column_profile(MESSY.read(spark, sf_dir)))


@query(
    "columns_of_type",
    f"""WITH {profile_cte(LINEITEM)} SELECT col AS "column", semantic_type FROM profile
WHERE semantic_type IN ('numeric_continuous', 'binary')""",
)
def columns_of_type(spark, sf_dir):
    found = profile.column_profile(LINEITEM.read(spark, sf_dir))
    return profile.columns_of_type(found, "numeric_continuous", "binary").select("column", "semantic_type")


@query(
    "profile_observations",
    f"""WITH {profile_cte(MESSY)}
SELECT coalesce(string_agg(col, ',' ORDER BY position) FILTER (WHERE semantic_type = 'identifier'), '') AS identifiers,
  coalesce(string_agg(col, ',' ORDER BY position) FILTER (WHERE semantic_type = 'constant'), '') AS constants,
  coalesce(string_agg(col, ',' ORDER BY position) FILTER (WHERE semantic_type = 'binary'), '') AS binaries,
  count(*) FILTER (WHERE missing_pct > 0) AS n_columns_with_gaps,
  (SELECT col FROM profile WHERE missing_pct > 0 ORDER BY missing_pct DESC, position LIMIT 1) AS worst_gap_column,
  max(missing_pct) FILTER (WHERE missing_pct > 0) AS worst_gap_pct
FROM profile""",
)
def profile_observations(spark, sf_dir):
    return profile.observations(profile.column_profile(MESSY.read(spark, sf_dir)))


@query(
    "whole_valued_columns",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", bool_and({c} % 1 = 0) AS whole FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    ),
)
def whole_valued(spark, sf_dir):
    df = LINEITEM.read(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    return profile.column_facts(df).select("column", "whole")


@query(
    "text_shape",
    f"""WITH {profile_cte(PART)} SELECT col AS "column", round(avg_length, 4) AS avg_length,
round(space_share, 4) AS space_share FROM profile WHERE kind = 's'""",
)
def text_shape(spark, sf_dir):
    df = PART.read(spark, sf_dir).select("p_name", "p_brand", "p_type")
    return profile.column_facts(df).select(
        "column", F.round("avg_length", 4).alias("avg_length"), F.round("space_share", 4).alias("space_share")
    )
