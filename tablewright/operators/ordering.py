"""Positions, ranks and quantiles without sorting a whole table in one task."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, present
from ..session import cut_lineage

ROWS_PER_BUCKET = 1_000_000
# Slices that the values around an order statistic are dealt into by one scan, and pairs of bounds that a scan looks at.
GATHERED = 4_000
BRACKETS_PER_PASS = 60
# Columns per aggregate: few enough for the JVM to compile the generated code.
TARGETS_PER_PASS = 6


def running_total(counts: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """Add `before`: the sum of `weight` over the rows of the same group with a smaller `value`.

    (group, value) must be unique. Rows are range-partitioned into as many partitions as the session
    shuffles into, the partition number is written down, and each partition adds up its own rows
    on top of the totals of the partitions before it.
    """
    so_far = (
        Window.partitionBy(group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut_lineage(counts.repartitionByRange(F.col(group), F.col(value)).withColumn("__part", F.spark_partition_id()))
    totals = local.groupBy(group, "__part").agg(F.sum(weight).alias("__total"))
    # one row per group and partition it touches
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(group, "__part", (F.sum("__total").over(earlier) - F.col("__total")).alias("__offset"))
    return (
        local.withColumn("before", F.sum(weight).over(so_far) - F.col(weight))
        .join(offsets, [group, "__part"])
        .withColumn("before", F.col("before") + F.col("__offset"))
        .drop("__part", "__offset")
    )


def running_totals(counts: DataFrame, group: str, value: str, weights: list[str]) -> DataFrame:
    """Like `running_total` for several weights in one pass: adds `before_<weight>` for each."""
    so_far = Window.partitionBy(group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = cut_lineage(counts.repartitionByRange(F.col(group), F.col(value)).withColumn("__part", F.spark_partition_id()))
    totals = local.groupBy(group, "__part").agg(*[F.sum(w).alias(f"__{w}") for w in weights])
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "__part", *[F.coalesce(F.sum(f"__{w}").over(earlier), F.lit(0)).alias(f"__{w}") for w in weights])
    inside = {f"before_{w}": F.coalesce(F.sum(w).over(so_far), F.lit(0)) for w in weights}
    return (
        local.withColumns(inside)
        .join(offsets, [group, "__part"])
        .withColumns({f"before_{w}": F.col(f"before_{w}") + F.col(f"__{w}") for w in weights})
        .drop("__part", *[f"__{w}" for w in weights])
    )


def average_ranks(counts: DataFrame) -> DataFrame:
    """(column, value, rank) from (column, value, n): equal values share their average rank."""
    placed = running_total(counts, "column", "value", "n")
    return placed.select("column", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def label_positions(labels: DataFrame) -> DataFrame:
    """(column, label, position) from distinct (column, label): labels of a column in sorted order, numbered from 0."""
    placed = running_total(labels.select("column", "label", F.lit(1).alias("one")), "column", "label", "one")
    return placed.select("column", "label", F.col("before").cast("bigint").alias("position"))


def positions_within(
    df: DataFrame, group: list[str], order: Column, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Add `position`: 0, 1, 2.. inside each group, in a scrambled but repeatable order.

    `order` is an integer hash of a unique row key. A group is cut into hash buckets, rows are
    numbered inside their bucket and the bucket totals shift them, so that no task ever holds
    a whole group.
    """
    buckets = max(1, math.ceil(n_rows / rows_per_bucket))
    keyed = df.withColumn("__order", order).withColumn("__bucket", F.pmod("__order", F.lit(buckets)))
    inside = Window.partitionBy(*[col(g) for g in group], "__bucket").orderBy("__order")
    numbered = keyed.withColumn("position", F.row_number().over(inside) - 1)
    if buckets > 1:
        sizes = keyed.groupBy(*[col(g) for g in group], "__bucket").agg(F.count(F.lit(1)).alias("__size"))
        earlier = (
            Window.partitionBy(*[col(g) for g in group]).orderBy("__bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        offsets = sizes.withColumn("__offset", F.sum("__size").over(earlier) - F.col("__size")).drop("__size")
        keys = [*group, "__bucket"]
        same = None
        right = offsets.select(*[col(k).alias(f"__r{i}") for i, k in enumerate(keys)], "__offset")
        for i, k in enumerate(keys):
            test = col(k).eqNullSafe(F.col(f"__r{i}"))
            same = test if same is None else same & test
        numbered = (
            numbered.join(right, same, "left")
            .withColumn("position", F.col("position") + F.coalesce("__offset", F.lit(0)))
            .drop("__offset", *[f"__r{i}" for i in range(len(keys))])
        )
    return numbered.drop("__order", "__bucket").withColumn("position", F.col("position").cast("bigint"))


def hash_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows picked by the hash of their key: repeatable, and a top-n rather than a sort.

    The order is the MD5 of seed and key as text, which any engine computes. Each task keeps its n first rows, so samples of parts
    of a table, taken again together, are the sample of the whole.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in key])
    return df.orderBy(F.md5(text), *[col(k) for k in key]).limit(n)


def in_passes(df: DataFrame, expressions: list[Column]) -> list:
    """The values of many aggregates, a few of them per pass; each pass reads only its own columns."""
    values = []
    for start in range(0, len(expressions), TARGETS_PER_PASS):
        chunk = expressions[start : start + TARGETS_PER_PASS]
        values += list(df.agg(*[e.alias(f"v{i}") for i, e in enumerate(chunk)]).first())
    return values


def _slices(numbers: DataFrame, brackets: list[tuple[str, float, float]], targets: list[tuple[int, int]], slices: int) -> list:
    """Count before, least and largest value of the slice that holds each target (bracket, rank within the bracket).

    One scan deals the values of all brackets into equal slices of their brackets. Dealing is monotone, the lowest value of a bracket
    and the highest never share a slice, and the infinities have slices of their own.
    """
    low, high = ([max(min(b[k], sys.float_info.max), -sys.float_info.max) for b in brackets] for k in (1, 2))
    # halves, as the distance of two doubles may be none
    half = [h / 2 - x / 2 for x, h in zip(low, high)]

    def of(values: list[float]) -> Column:
        return F.get(F.lit(values), F.col("bracket"))

    v = F.col("v")
    within = F.when(of(half) > 0, F.floor((v / 2 - of(low) / 2) / F.when(of(half) > 0, of(half)) * slices).cast("int"))
    dealt = F.when(v == float("inf"), slices + 1).when(v == float("-inf"), -1).otherwise(F.coalesce(within, (v > of(low)).cast("int")))
    # values beside their places and not one structure for each bracket: generated code stays short
    cells = numbers.select(F.posexplode(F.array(*[col(c) for c, _, _ in brackets])).alias("bracket", "v"))
    counts = (
        cells.where((v >= of([b[1] for b in brackets])) & (v <= of([b[2] for b in brackets])))
        .groupBy("bracket", dealt.alias("slice"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"))
    )
    # a bracket has a bounded number of slices
    so_far = Window.partitionBy("bracket").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
    wanted = [[r for b, r in targets if b == i] for i in range(len(brackets))]
    mine = F.get(F.lit(wanted).cast("array<array<bigint>>"), F.col("bracket"))
    inside = F.filter(mine, lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n")))
    held = placed.select("bracket", "before", "least", "largest", F.explode(inside).alias("rank"))
    found = {(r["bracket"], r["rank"]): r for r in held.collect()}
    return [found[t] for t in targets]


def exact_quantiles(df: DataFrame, probabilities: dict[str, list[float]], gathered: int = GATHERED) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of many columns.

    Like `DataFrame.approxQuantile` this runs at once and returns plain numbers. Each wanted order
    statistic is closed in from the least and largest value: every round deals the values between two
    bounds into `gathered` slices, and the slice that holds the wanted rank gives the next bounds, until they
    are one value. A round is one scan for all columns and statistics, with an aggregate of a size that does not
    depend on the table; nothing is sorted whole.
    """
    numbers = df.select(*[present(df, c).cast("double").alias(c) for c in probabilities])
    names = list(probabilities)
    head = in_passes(numbers, [F.struct(F.count(col(c)), F.min(col(c)), F.max(col(c))) for c in names])
    sizes = {c: h[0] for c, h in zip(names, head)}
    targets, known = [], {}
    for c, (n, low, high) in zip(names, head):
        ranks = {r for p in probabilities[c] if n for r in (math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1))}
        targets += [{"column": c, "rank": r, "low": low, "high": high, "below": 0} for r in sorted(ranks)]

    while targets:
        for t in targets:
            if t["low"] == t["high"]:
                known[t["column"], t["rank"]] = t["low"]
        targets = [t for t in targets if t["low"] != t["high"]]
        brackets = list(dict.fromkeys((t["column"], t["low"], t["high"]) for t in targets))
        for start in range(0, len(brackets), BRACKETS_PER_PASS):
            chunk = brackets[start : start + BRACKETS_PER_PASS]
            place = {b: i for i, b in enumerate(chunk)}
            own = [t for t in targets if (t["column"], t["low"], t["high"]) in place]
            asked = [(place[t["column"], t["low"], t["high"]], t["rank"] - t["below"]) for t in own]
            for t, r in zip(own, _slices(numbers, chunk, asked, max(2, gathered))):
                t["next"] = (r["least"], r["largest"], t["below"] + r["before"])
        for t in targets:
            t["low"], t["high"], t["below"] = t.pop("next")

    def quantile(c: str, p: float) -> float | None:
        if not sizes[c]:
            return None
        spot = (sizes[c] - 1) * p
        low = math.floor(spot)
        lower, upper = known[c, low], known[c, min(low + 1, sizes[c] - 1)]
        return lower if spot == low or lower == upper else (low + 1 - spot) * lower + (spot - low) * upper

    return {c: [quantile(c, p) for p in probabilities[c]] for c in names}
