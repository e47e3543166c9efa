"""CSV reading, versions and the history of results."""

from pyspark.sql import functions as F

from tablewright.plans import analyses
from tablewright.session import scratch_folder
from tablewright.sources import history, tables, versions

from .health_queries import ISSUE_COLUMNS, ISSUE_SQL, issues_cte
from .relations import DOCUMENTS, LABELS, ORDERS, PART, Relation, query

CSV_TOKENS = Relation(
    "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"],
    {
        "price": ("CASE WHEN o_orderkey % 10 = 0 THEN 'NA' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) END", "s"),
        "priority": ("CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE o_orderpriority END", "s"),
    },
)


@query(
    "csv_scan",
    f"""SELECT o_orderstatus, count(*) AS n, count(try_cast(price AS BIGINT)) AS n_price, sum(try_cast(price AS BIGINT))::BIGINT AS total,
count(CASE WHEN priority <> 'null' THEN 1 END) AS n_priority, min(o_orderdate) AS first_date, 'bigint' AS price_type
FROM {CSV_TOKENS.sql} GROUP BY o_orderstatus""",
)
def csv_scan(spark, sf_dir):
    """orders written as CSV with missing tokens, and read back with inferred types."""
    path = scratch_folder(spark, "csv")
    CSV_TOKENS.read(spark, sf_dir).write.option("header", True).csv(path)
    df = tables.read_csv(spark, path)
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.sum("price").alias("total"),
        F.count("priority").alias("n_priority"), F.min("o_orderdate").cast("timestamp_ntz").alias("first_date"),
        F.lit(dict(df.dtypes)["price"]).alias("price_type"),
    )


NAMES = "concat(replace(p_name, ' ', '_'), CASE WHEN p_size > 40 THEN '' ELSE concat('_v', CAST(p_size AS VARCHAR(9))) END)"


@query(
    "next_version_names",
    rf"""WITH names AS (SELECT {NAMES} AS name FROM part),
b AS (SELECT regexp_replace(name, '_v\d+$', '') AS base, try_cast(regexp_extract(name, '_v(\d+)$', 1) AS INT) AS v FROM names),
c AS (SELECT base, unnest(range(2, count(*)::INT + 3)) AS version FROM b GROUP BY base)
SELECT c.base, min(c.version)::INT AS next_version FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.base = c.base AND b.v = c.version) GROUP BY c.base""",
)
def next_version_names(spark, sf_dir):
    return versions.next_versions(PART.read(spark, sf_dir).select(F.expr(NAMES).alias("name")))


@query(
    "stored_versions",
    """SELECT * FROM (VALUES ('orders', 1, (SELECT count(*) FROM orders), 6), ('orders_v2', 2, (SELECT count(*) FROM orders), 7),
('orders_v3', 3, (SELECT count(*) FROM orders), 5)) t(name, version, n_rows, n_columns)""",
)
def stored_versions(spark, sf_dir):
    from tablewright.operators.transforms import apply_transform

    store = versions.TableStore(spark, scratch_folder(spark, "store"))
    orders = ORDERS.read(spark, sf_dir)
    store.add("orders", orders)
    second = store.add_version("orders", apply_transform(orders, "log_transform", ["o_totalprice"]))
    store.add_version(second, apply_transform(orders, "drop_column", ["o_orderdate"]))
    return store.versions().select("name", "version", "n_rows", "n_columns")


@query("versions_newest_first", "SELECT o_orderkey AS id, concat('t', o_orderkey) AS name, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, name DESC")
def versions_newest_first(spark, sf_dir):
    catalog = ORDERS.read(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), F.col("o_orderkey")).alias("name"), F.col("o_orderdate").alias("created_at")
    )
    return versions.newest_first(catalog)


SESSIONS = (
    "SELECT o_orderkey AS session_id, o_custkey AS dataset_id, CASE WHEN o_orderpriority = '5-LOW' THEN '  ' "
    "WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE concat(' ', o_orderpriority) END AS target, o_orderdate AS created_at FROM orders"
)
CLEAN_SESSIONS = f"(SELECT session_id, dataset_id, nullif(trim(target), '') AS target, created_at FROM ({SESSIONS}))"


def sessions(spark, sf_dir):
    return ORDERS.read(spark, sf_dir).selectExpr(*[x.strip() for x in _select_list(SESSIONS)])


def _select_list(sql: str) -> list[str]:
    body = sql[len("SELECT ") : sql.index(" FROM ")]
    parts, depth, current = [], 0, ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [*parts, current]


@query(
    "active_sessions",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, target ORDER BY created_at DESC, session_id DESC) AS i FROM {CLEAN_SESSIONS})
SELECT dataset_id, target, session_id, created_at FROM s WHERE i = 1""",
)
def active_sessions(spark, sf_dir):
    return history.active_sessions(sessions(spark, sf_dir))


@query(
    "session_history",
    f"""SELECT session_id, dataset_id, target, created_at FROM {CLEAN_SESSIONS} WHERE dataset_id = 7 AND (target = '2-HIGH' OR target IS NULL)""",
)
def session_history(spark, sf_dir):
    return history.session_history(sessions(spark, sf_dir), 7, "2-HIGH")


@query("session_history_all_targets", f"SELECT session_id, dataset_id, target, created_at FROM {CLEAN_SESSIONS} WHERE dataset_id = 7")
def session_history_all(spark, sf_dir):
    return history.session_history(sessions(spark, sf_dir), 7)


ANALYSIS = (
    "CASE l_linenumber WHEN 1 THEN 'understand' WHEN 2 THEN 'health' WHEN 3 THEN 'investigate' WHEN 4 THEN 'statistics' "
    "WHEN 5 THEN 'feature-lab' WHEN 6 THEN 'recommend' ELSE 'report' END"
)
RESULTS = Relation(
    "lineitem", [],
    {
        "session_id": ("l_orderkey", "i"), "dataset_id": ("l_suppkey", "i"), "analysis": (ANALYSIS, "s"),
        "status": ("CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'failed' END", "s"),
        "target": ("CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END", "s"), "created_at": ("l_shipdate", "t"),
        "run_id": ("concat('r', l_partkey)", "s"),
    },
)


@query(
    "completed_analyses",
    f"""WITH f AS (SELECT session_id, analysis, min(created_at) AS created_at FROM {RESULTS.sql} WHERE status = 'completed' GROUP BY 1, 2)
SELECT session_id, string_agg(analysis, ',' ORDER BY created_at, analysis) AS analyses FROM f GROUP BY session_id""",
)
def completed_analyses(spark, sf_dir):
    found = history.completed_analyses(RESULTS.read(spark, sf_dir))
    return found.select("session_id", F.array_join("analyses", ",").alias("analyses"))


@query(
    "stored_results_latest",
    f"""WITH r AS (SELECT *, CASE WHEN analysis IN ('understand', 'health') THEN NULL ELSE nullif(trim(target), '') END AS effective,
  row_number() OVER (PARTITION BY session_id, analysis ORDER BY created_at DESC, run_id DESC) AS i FROM {RESULTS.sql})
SELECT session_id, analysis, effective AS target, created_at, run_id FROM r WHERE i = 1""",
)
def stored_results_latest(spark, sf_dir):
    path = scratch_folder(spark, "history")
    history.append_results(RESULTS.read(spark, sf_dir).dropDuplicates(["session_id", "analysis", "created_at", "run_id"]), path)
    return history.latest_results(spark.read.parquet(path)).select("session_id", "analysis", "target", "created_at", "run_id")


REQUESTS = Relation(
    "lineitem", [],
    {
        "dataset_id": ("l_suppkey", "i"), "analysis": (ANALYSIS, "s"),
        "target": ("CASE WHEN l_returnflag = 'R' THEN 'R ' ELSE concat(l_returnflag, CAST(l_quantity AS INT)) END", "s"),
        "refresh": ("l_quantity = 1 AND l_tax = 0", "b"),
    },
)


@query(
    "analyses_to_run",
    f"""WITH q AS (SELECT dataset_id, analysis, refresh, CASE WHEN analysis IN ('understand', 'health') THEN NULL ELSE nullif(trim(target), '') END AS target FROM {REQUESTS.sql}),
d AS (SELECT DISTINCT dataset_id, analysis, CASE WHEN analysis IN ('understand', 'health') THEN NULL ELSE nullif(trim(target), '') END AS target
  FROM {RESULTS.sql} WHERE status = 'completed')
SELECT dataset_id, analysis, target, refresh FROM q WHERE refresh OR NOT EXISTS (
  SELECT 1 FROM d WHERE d.dataset_id = q.dataset_id AND d.analysis = q.analysis AND d.target IS NOT DISTINCT FROM q.target)""",
)
def analyses_to_run(spark, sf_dir):
    return history.analyses_to_run(REQUESTS.read(spark, sf_dir), RESULTS.read(spark, sf_dir)).select(
        "dataset_id", "analysis", "target", "refresh"
    )


@query("stored_health_run", f"WITH {issues_cte(LABELS)} SELECT {ISSUE_SQL} FROM issues")
def stored_health_run(spark, sf_dir):
    """Run an analysis, store its table and its history row, and read the stored table."""
    found = analyses.run_and_store(LABELS.read(spark, sf_dir), "health", scratch_folder(spark, "runs"), 1, 1)
    return found.select(*ISSUE_COLUMNS)


@query(
    "stored_results_reused",
    "SELECT 1 AS n_runs_after_two, 2 AS n_runs_after_refresh, (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY lang HAVING count(*) > 0)) AS n_langs",
)
def stored_results_reused(spark, sf_dir):
    """The second call reads what the first one stored; a refresh runs again."""
    root, df = scratch_folder(spark, "reused"), DOCUMENTS.read(spark, sf_dir)
    analyses.stored_or_run(df, "understand", root, 1, 1)
    again = analyses.stored_or_run(df, "understand", root, 2, 1, target="ignored here")
    after_two = spark.read.parquet(f"{root}/history").count()
    analyses.stored_or_run(df, "understand", root, 2, 1, refresh=True)
    return again.where("column = 'lang'").select(
        F.lit(after_two).alias("n_runs_after_two"),
        F.lit(spark.read.parquet(f"{root}/history").count()).alias("n_runs_after_refresh"), F.col("n_unique").alias("n_langs"),
    )


PRICED = Relation("lineitem", ["l_quantity", "l_extendedprice", "l_tax"], {"fixed": ("'x'", "s")})
PRICED_AFTER = Relation("lineitem", ["l_quantity", "l_extendedprice", "l_tax"])


def _score_sql(rel: Relation) -> str:
    from .health_queries import GRADE_SQL, SCORE_SQL

    return f"(WITH {issues_cte(rel)}, s AS ({SCORE_SQL}) SELECT score, {GRADE_SQL} AS grade FROM s)"


@query(
    "derived_version_health",
    f"""SELECT 'priced_v2' AS name, b.score AS score_before, a.score AS score_after, round(a.score - b.score, 1) AS delta
FROM {_score_sql(PRICED)} b, {_score_sql(PRICED_AFTER)} a""",
)
def derived_version(spark, sf_dir):
    store = versions.TableStore(spark, scratch_folder(spark, "store"))
    store.add("priced", PRICED.read(spark, sf_dir))
    name, change = analyses.derive_version(store, "priced", "drop_column", ["fixed"])
    return change.select(F.lit(name).alias("name"), "score_before", "score_after", "delta")
