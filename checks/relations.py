"""Input relations, written once and read by both engines, and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Column types: i integer, d double, s text, t timestamp, b boolean, n nested.
TABLES = {
    "lineitem": "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity d, l_extendedprice d, l_discount d, "
    "l_tax d, l_returnflag s, l_linestatus s, l_shipdate t",
    "orders": "o_orderkey i, o_custkey i, o_orderstatus s, o_totalprice d, o_orderdate t, o_orderpriority s",
    "customer": "c_custkey i, c_name s, c_nationkey i, c_acctbal d, c_mktsegment s",
    "part": "p_partkey i, p_name s, p_brand s, p_type s, p_size i, p_retailprice d",
    "supplier": "s_suppkey i, s_name s, s_nationkey i, s_acctbal d",
    "nation": "n_nationkey i, n_name s, n_regionkey i",
    "region": "r_regionkey i, r_name s",
    "events": "event_id i, ts t, user_id i, event_type s, value d, props s",
    "documents": "doc_id i, text s, lang s, source s, n_chars i",
    "labels": "doc_id i, quality i, toxic i",
    "embeddings": "vec_id i, embedding n, label i",
    "conversations": "conv_id i, turn i, role s, text s",
    "pages": "page_id i, url s, html s",
    "benchmark": "item_id i, text s",
}


def _types(spec: str) -> dict[str, str]:
    return dict(part.split() for part in spec.split(", "))


@dataclass
class Relation:
    """A table, optionally cut to some columns, with derived columns both engines can compute."""

    table: str
    keep: list[str] | None = None
    derived: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def types(self) -> dict[str, str]:
        base = _types(TABLES[self.table])
        kept = {c: base[c] for c in (self.keep if self.keep is not None else base)}
        return {**kept, **{c: t for c, (_, t) in self.derived.items()}}

    def _exprs(self) -> list[str]:
        base = list(_types(TABLES[self.table])) if self.keep is None else self.keep
        return [*base, *[f"{e} AS {c}" for c, (e, _) in self.derived.items()]]

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").selectExpr(*self._exprs())

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(self._exprs())} FROM {self.table})"


LINEITEM = Relation("lineitem")
ORDERS = Relation("orders")
CUSTOMER = Relation("customer")
PART = Relation("part")
EVENTS = Relation("events")
DOCUMENTS = Relation("documents")
LABELS = Relation("labels")

GAP = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END"
# lineitem with everything the checks look for: gaps, a constant, mixed spellings, a hot label
MESSY = Relation(
    "lineitem",
    ["l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    {
        "gap": (GAP, "d"),
        "mostly_gap": ("CASE WHEN l_linenumber > 2 THEN NULL ELSE l_tax END", "d"),
        "fixed": ("'x'", "s"),
        "spelling": (
            "CASE WHEN l_linenumber % 2 = 0 THEN lower(l_returnflag) ELSE concat(' ', l_returnflag) END", "s",
        ),
        "mostly": ("CASE WHEN l_quantity > 2 THEN 'yes' ELSE 'no' END", "s"),
        "bucket": ("concat('b', CAST(CASE WHEN l_orderkey < 3 THEN 10 * l_orderkey + l_linenumber ELSE 99 END AS VARCHAR(20)))", "s"),
        "price_level": ("CASE WHEN l_extendedprice > 100000 THEN 50.0 * l_extendedprice ELSE l_extendedprice END", "d"),
    },
)
# lineitem with planted relations: a function of price, and groups of quantity
PLANTED = Relation(
    "lineitem",
    ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    {
        "net": ("l_extendedprice * (1 - l_discount)", "d"),
        "gap": (GAP, "d"),
        "halves": ("CASE WHEN l_quantity > 25 THEN 'hi' ELSE 'lo' END", "s"),
        "thirds": ("CASE WHEN l_quantity > 33 THEN 'c' WHEN l_quantity > 16 THEN 'b' ELSE 'a' END", "s"),
        "mostly": ("CASE WHEN l_quantity > 2 THEN 'yes' ELSE 'no' END", "s"),
    },
)

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is its counterpart, None where SQL cannot express it."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = (function, sql)
        return function

    return register


# ---- SQL building blocks --------------------------------------------------------------------


def pct(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) = 0 THEN 0.0 ELSE floor((20000 * ({part}) + ({whole})) / (2 * ({whole}))) / 100.0 END)"


def _facts_sql(rel: Relation, column: str, kind: str, position: int) -> str:
    n = "NULL::DOUBLE"
    numeric = kind in "id"
    stats = (
        [
            f"min({column})::DOUBLE", f"max({column})::DOUBLE", f"avg({column})", f"stddev_samp({column})",
            f"quantile_cont({column}, 0.25)::DOUBLE", f"quantile_cont({column}, 0.5)::DOUBLE",
            f"quantile_cont({column}, 0.75)::DOUBLE",
            f"CASE WHEN count({column}) > 2 AND min({column}) < max({column}) THEN skewness({column}) ELSE 0.0 END",
        ]
        if numeric
        else [n] * 8
    )
    whole = "true" if kind == "i" else f"coalesce(bool_and({column} % 1 = 0), true)" if kind == "d" else "false"
    text = [f"avg(length({column}))", f"avg((instr({column}, ' ') > 0)::INT)"] if kind == "s" else [n, n]
    moment = [f"min({column})::VARCHAR", f"max({column})::VARCHAR"] if kind == "t" else ["NULL::VARCHAR"] * 2
    unique = "NULL::BIGINT" if kind == "n" else f"count(DISTINCT {column})"
    names = (
        "position, col, kind, n_total, n_present, n_unique, min, max, mean, std, q25, q50, q75, skew, whole, "
        "avg_length, space_share, earliest, latest"
    ).split(", ")
    values = [
        str(position), f"'{column}'", f"'{kind}'", "count(*)", f"count({column})", unique, *stats, whole, *text, *moment,
    ]
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in zip(names, values)) + f" FROM {rel.sql}"


def profile_cte(rel: Relation, name: str = "profile") -> str:
    """CTEs ending in `name`: one row per column with its semantic type and unrounded facts."""
    facts = " UNION ALL ".join(_facts_sql(rel, c, k, i) for i, (c, k) in enumerate(rel.types.items()))
    share = "(n_unique::DOUBLE / nullif(n_present, 0))"
    return f"""{name}_facts AS ({facts}),
{name} AS (
  SELECT *, n_total - n_present AS n_missing,
    {pct('n_total - n_present', 'n_total')} AS missing_pct,
    CASE WHEN n_unique IS NULL THEN NULL ELSE {pct('n_unique', 'n_present')} END AS unique_pct,
    CASE WHEN kind = 'n' THEN 'unknown'
         WHEN n_unique <= 1 THEN 'constant'
         WHEN kind = 't' THEN 'datetime'
         WHEN n_unique = 2 THEN 'binary'
         WHEN kind IN ('i', 'd') AND whole AND {share} >= 0.98 THEN 'identifier'
         WHEN kind IN ('i', 'd') AND whole AND n_unique <= 20 THEN 'numeric_discrete'
         WHEN kind IN ('i', 'd') THEN 'numeric_continuous'
         WHEN kind = 's' AND {share} >= 0.9 AND space_share <= 0.5 AND avg_length <= 20 THEN 'identifier'
         WHEN kind = 's' AND {share} >= 0.9 THEN 'text'
         WHEN kind = 's' THEN 'categorical'
         WHEN kind = 'b' THEN 'binary'
         ELSE 'unknown' END AS semantic_type
  FROM {name}_facts)"""


def levels_sql(rel: Relation, columns: list[str]) -> str:
    """(col, value, n) of some columns, values as text."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c}::VARCHAR AS value, count(*) AS n FROM {rel.sql} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in columns
    )


NUMERIC_SQL = "semantic_type IN ('numeric_continuous', 'numeric_discrete')"
GROUP_SQL = "semantic_type IN ('categorical', 'binary')"


def average_rank_sql(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0)"


def numeric_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
