"""Column transforms, projections and predicates."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.functions import scalar
from tablewright.operators import transforms
from tablewright.operators.ordering import hash_sample
from tablewright.sources import tables

from .relations import CUSTOMER, DOCUMENTS, EVENTS, LINEITEM, ORDERS, PART, PLANTED, Relation, query

# rows keep their two-part key; `gap` has missing values
KEYED = Relation(
    "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    {
        "gap": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END", "d"),
        "signed": ("l_quantity - 5", "d"),
        "label": ("CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('q', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9))) END", "s"),
        "numbers": ("CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(9)) END", "s"),
        "day": ("CASE WHEN l_linenumber = 7 THEN 'soon' ELSE substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END", "s"),
    },
)
KEY = ["l_orderkey", "l_partkey", "l_linenumber"]


def applied(name: str, transform: str, columns: list[str], out: list[str], sql: str, evidence: dict | None = None, digits: int = 6):
    kept = ", ".join(KEY)

    @query(name, f"SELECT {kept}, {sql} FROM {KEYED.sql} base")
    def run(spark, sf_dir):
        df = transforms.apply_transform(KEYED.read(spark, sf_dir), transform, columns, evidence)
        types = dict(df.dtypes)
        return df.select(*KEY, *[(F.round(c, digits).alias(c) if types[c] == "double" else F.col(c)) for c in out])


def scalar_of(expression: str) -> str:
    return f"(SELECT {expression} FROM {KEYED.sql} s)"


applied(
    "log_transform", "log_transform", ["l_extendedprice", "l_tax"], ["l_extendedprice_log", "l_tax_log"],
    "round(ln(l_extendedprice), 6) AS l_extendedprice_log, round(ln(1 + l_tax), 6) AS l_tax_log",
)
applied(
    "sqrt_transform", "sqrt_transform", ["signed", "gap"], ["signed_sqrt", "gap_sqrt"],
    "round(sqrt(CASE WHEN signed < 0 THEN 0 ELSE signed END), 6) AS signed_sqrt, round(sqrt(gap), 6) AS gap_sqrt",
)
applied(
    "standard_scale", "standard_scale", ["l_extendedprice", "gap"], ["l_extendedprice", "gap"],
    f"round((l_extendedprice - {scalar_of('avg(l_extendedprice)')}) / {scalar_of('stddev_pop(l_extendedprice)')}, 5) AS l_extendedprice, "
    f"round((gap - {scalar_of('avg(gap)')}) / {scalar_of('stddev_pop(gap)')}, 5) AS gap", digits=5,
)
applied(
    "minmax_scale", "minmax_scale", ["l_extendedprice", "gap"], ["l_extendedprice", "gap"],
    f"round((l_extendedprice - {scalar_of('min(l_extendedprice)')}) / ({scalar_of('max(l_extendedprice)')} - {scalar_of('min(l_extendedprice)')}), 6) AS l_extendedprice, "
    f"round((gap - {scalar_of('min(gap)')}) / ({scalar_of('max(gap)')} - {scalar_of('min(gap)')}), 6) AS gap",
)
applied(
    "clip_outliers_percentiles", "clip_outliers", ["l_extendedprice", "gap"], ["l_extendedprice", "gap"],
    ", ".join(
        f"round(CASE WHEN {c} < {scalar_of(f'quantile_cont({c}, 0.01)')} THEN {scalar_of(f'quantile_cont({c}, 0.01)')} "
        f"WHEN {c} > {scalar_of(f'quantile_cont({c}, 0.99)')} THEN {scalar_of(f'quantile_cont({c}, 0.99)')} ELSE {c} END, 4) AS {c}"
        for c in ("l_extendedprice", "gap")
    ), digits=4,
)
applied(
    "clip_outliers_bounds", "clip_outliers", ["l_quantity"], ["l_quantity"],
    "CASE WHEN l_quantity < 5.5 THEN 5.5 WHEN l_quantity > 40 THEN 40.0 ELSE l_quantity END AS l_quantity",
    {"lower_bound": 5.5, "upper_bound": 40.0},
)


@query(
    "clipped_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(lo, 4) AS lower_bound, round(hi, 4) AS upper_bound,
(SELECT count(*) FROM {KEYED.sql} WHERE {c} < lo OR {c} > hi) AS n_clipped
FROM (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM {KEYED.sql})"""
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def clipped_counts(spark, sf_dir):
    found = transforms.clipped_counts(KEYED.read(spark, sf_dir), ["l_extendedprice", "l_quantity"])
    return found.select("column", F.round("lower_bound", 4).alias("lower_bound"), F.round("upper_bound", 4).alias("upper_bound"), "n_clipped")


def bins_sql(c: str, k: int) -> str:
    inner = " + ".join(
        f"CASE WHEN {c} > {scalar_of(f'quantile_cont({c}, {i / k})')} AND {scalar_of(f'quantile_cont({c}, {i / k})')} > "
        f"{scalar_of(f'quantile_cont({c}, {(i - 1) / k})')} THEN 1 ELSE 0 END"
        for i in range(1, k)
    )
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE {inner} END AS {c}_binned"


applied("bin_numeric_quartiles", "bin_numeric", ["l_extendedprice", "gap"], ["l_extendedprice_binned", "gap_binned"],
        f"{bins_sql('l_extendedprice', 4)}, {bins_sql('gap', 4)}")
applied("bin_numeric_ten", "bin_numeric", ["l_quantity"], ["l_quantity_binned"], bins_sql("l_quantity", 10), {"n_bins": 10})
applied(
    "one_hot_encode", "one_hot_encode", ["l_returnflag", "l_linestatus"],
    ["l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_F", "l_linestatus_O"],
    ", ".join(f"coalesce(l_returnflag = '{v}', false) AS l_returnflag_{v}" for v in "ANR")
    + ", " + ", ".join(f"coalesce(l_linestatus = '{v}', false) AS l_linestatus_{v}" for v in "FO"),
)


@query(
    "one_hot_vectors",
    f"""SELECT {', '.join(KEY)}, (SELECT count(DISTINCT s.label) FROM {KEYED.sql} s)::INT AS size,
CASE WHEN label IS NULL THEN 0 ELSE (SELECT count(DISTINCT s.label) FROM {KEYED.sql} s WHERE s.label <= base.label) END::BIGINT AS one_at FROM {KEYED.sql} base""",
)
def one_hot_vectors(spark, sf_dir):
    df, _ = transforms.one_hot_vectors(KEYED.read(spark, sf_dir), ["label"])
    ones = vector_to_array("label_vector")
    return df.select(*KEY, F.size(ones).alias("size"), F.array_position(ones, 1.0).alias("one_at"))


@query(
    "one_hot_label_index",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::VARCHAR AS label, rank() OVER (ORDER BY {c}) - 1 AS position FROM (SELECT DISTINCT {c} FROM {KEYED.sql} s WHERE {c} IS NOT NULL)"""
        for c in ("label", "l_linestatus")
    ),
)
def one_hot_label_index(spark, sf_dir):
    return transforms.one_hot_vectors(KEYED.read(spark, sf_dir), ["label", "l_linestatus"])[1]


applied(
    "ordinal_encode", "ordinal_encode", ["label"], ["label"],
    f"CASE WHEN label IS NULL THEN NULL ELSE (SELECT count(DISTINCT s.label) FROM {KEYED.sql} s WHERE s.label < base.label) END AS label",
)
applied(
    "frequency_encode", "frequency_encode", ["label"], ["label_freq"],
    f"round((SELECT f.share FROM (SELECT s.label AS l, count(*)::DOUBLE / {scalar_of('count(label)')} AS share FROM {KEYED.sql} s GROUP BY s.label) f WHERE f.l = base.label), 6) AS label_freq",
)
applied(
    "group_rare_labels", "group_rare", ["label"], ["label"],
    f"CASE WHEN label IN (SELECT s.label FROM {KEYED.sql} s WHERE s.label IS NOT NULL GROUP BY s.label HAVING count(*)::DOUBLE / {scalar_of('count(label)')} < 0.02) THEN 'Other' ELSE label END AS label",
)
applied(
    "extract_datetime_parts", "extract_datetime_parts", ["l_shipdate"],
    ["l_shipdate_year", "l_shipdate_month", "l_shipdate_dayofweek", "l_shipdate_is_weekend"],
    "year(l_shipdate)::INT AS l_shipdate_year, month(l_shipdate)::INT AS l_shipdate_month, (isodow(l_shipdate) - 1)::INT AS l_shipdate_dayofweek, "
    "(isodow(l_shipdate) >= 6)::INT AS l_shipdate_is_weekend",
)
applied(
    "extract_datetime_parts_from_text", "extract_datetime_parts", ["day"], ["day_year", "day_dayofweek", "day_is_weekend"],
    "year(try_cast(day AS DATE))::INT AS day_year, (isodow(try_cast(day AS DATE)) - 1)::INT AS day_dayofweek, "
    "coalesce(isodow(try_cast(day AS DATE)) >= 6, false)::INT AS day_is_weekend",
)
applied("drop_column", "drop_column", ["gap"], ["l_quantity"], "l_quantity")
applied("text_length_gaps", "text_feature", ["label"], ["label_length"], "length(coalesce(label, '')) AS label_length")


@query("text_feature_documents", "SELECT doc_id, length(coalesce(text, '')) AS text_length FROM documents")
def text_feature(spark, sf_dir):
    return transforms.apply_transform(DOCUMENTS.read(spark, sf_dir), "text_feature", ["text"]).select("doc_id", "text_length")


@query("label_shares", "SELECT p_brand AS label, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(p_brand) FROM part), 6) AS share FROM part GROUP BY p_brand")
def label_shares(spark, sf_dir):
    return transforms.label_shares(PART.read(spark, sf_dir), "p_brand").withColumn("share", F.round("share", 6))


# ---- projections and predicates -------------------------------------------------------------


@query("rows_with_target", f"SELECT l_linenumber, count(*) AS n FROM {PLANTED.sql} WHERE gap IS NOT NULL GROUP BY l_linenumber")
def rows_with_target(spark, sf_dir):
    return scalar.with_target(PLANTED.read(spark, sf_dir), "gap").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("complete_pairs", f"SELECT gap, l_tax, count(*) AS n FROM {PLANTED.sql} WHERE gap IS NOT NULL AND l_tax IS NOT NULL GROUP BY gap, l_tax")
def complete_pairs(spark, sf_dir):
    return scalar.complete_rows(PLANTED.read(spark, sf_dir), ["gap", "l_tax"]).groupBy("gap", "l_tax").agg(F.count(F.lit(1)).alias("n"))


@query("random_sample", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000")
def random_sample(spark, sf_dir):
    """The sampling operator: 2000 rows of the whole table, picked by hash."""
    return hash_sample(ORDERS.read(spark, sf_dir), ["o_orderkey"], 2000)


@query("background_sample", "SELECT * FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 100")
def background_sample(spark, sf_dir):
    return hash_sample(EVENTS.read(spark, sf_dir), ["event_id"], 100)


@query("text_search", "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(coalesce(c_mktsegment, '')), 'build')")
def text_search(spark, sf_dir):
    return tables.search(CUSTOMER.read(spark, sf_dir), "c_mktsegment", "BUILD").select("c_custkey", "c_mktsegment")


@query("sorted_rows", "SELECT c_custkey, c_acctbal, c_name FROM customer")
def sorted_rows(spark, sf_dir):
    return tables.sort_by(CUSTOMER.read(spark, sf_dir), "c_acctbal", "desc").select("c_custkey", "c_acctbal", "c_name")


@query("sorted_top", "SELECT p_partkey, p_name FROM part ORDER BY p_name DESC, p_partkey LIMIT 20")
def sorted_top(spark, sf_dir):
    df = tables.sort_by(PART.read(spark, sf_dir), "p_name", "desc")
    return df.orderBy(F.desc("p_name"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("to_number", f"SELECT l_linenumber, count(*) AS n, count(try_cast(numbers AS DOUBLE)) AS n_numbers, sum(try_cast(numbers AS DOUBLE)) AS total FROM {KEYED.sql} GROUP BY l_linenumber")
def to_number(spark, sf_dir):
    number = scalar.to_number(F.col("numbers"))
    return KEYED.read(spark, sf_dir).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count(number).alias("n_numbers"), F.sum(number).alias("total")
    )


@query(
    "finite_or_null",
    """WITH x AS (SELECT l_linenumber, CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE
WHEN l_linenumber = 3 THEN '-Infinity'::DOUBLE ELSE l_quantity END AS v FROM lineitem)
SELECT l_linenumber, count(*) AS n, count(CASE WHEN isfinite(v) THEN v END) AS n_finite, sum(CASE WHEN isfinite(v) THEN v END) AS total
FROM x GROUP BY l_linenumber""",
)
def finite_or_null(spark, sf_dir):
    v = F.expr(
        "CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN double('Infinity') "
        "WHEN l_linenumber = 3 THEN double('-Infinity') ELSE l_quantity END"
    )
    finite = scalar.finite_or_null(F.col("v"))
    return LINEITEM.read(spark, sf_dir).withColumn("v", v).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_finite"), F.sum(finite).alias("total")
    )


@query(
    "normal_labels",
    r"""WITH x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE concat(' ', l_returnflag, chr(9)) END AS label FROM lineitem)
SELECT label, lower(regexp_replace(label, '^\s+|\s+$', '', 'g')) AS cleaned, count(*) AS n FROM x GROUP BY label""",
)
def normal_labels(spark, sf_dir):
    label = F.expr("CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE concat(' ', l_returnflag, chr(9)) END")
    return (
        LINEITEM.read(spark, sf_dir).select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("cleaned", scalar.normal_label(F.col("label")))
    )


@query("table_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def table_preview(spark, sf_dir):
    return tables.preview(ORDERS.read(spark, sf_dir), ["o_orderkey"], 10)
