"""Which columns move together, which groups differ, what stands out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import col, present, strength
from ..session import cut_lineage, spread
from .frequency import union_all
from .ordering import in_passes, running_totals
from .profile import GROUP_TYPES, NUMERIC_TYPES, Profile, profile_of

Pair = tuple[str, str]


def all_pairs(columns: list[str]) -> list[Pair]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _moment_rows(columns: list[str], centres: list[float], wanted: list[tuple[int, int]]):
    """Sums of a task for all wanted pairs, from one product of matrices for each kind of sum."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(columns)
        n, s, q, x = (np.zeros((size, size)) for _ in range(4))
        for batch in batches:
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            there = ~np.isnan(values)
            centred = np.where(there, values - centres, 0.0)
            mask = there.astype(float)
            n += mask.T @ mask
            s += centred.T @ mask
            q += (centred * centred).T @ mask
            x += centred.T @ centred
        i, j = (np.array(k, dtype=int) for k in zip(*wanted))
        sums = [n[i, j], s[i, j], s[j, i], q[i, j], q[j, i], x[i, j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(wanted), dtype=np.int32)), *[pa.array(v) for v in sums]], ["pair", *MOMENTS]
        )

    return rows


def _centres(df: DataFrame, columns: list[str]) -> list[float]:
    """The mean of each column, or the one value of a column without spread, which is then exactly zero around it."""
    found = in_passes(df, [F.struct(F.min(c), F.max(c), F.avg(c)) for c in (col(c).cast("double") for c in columns)])
    middle = [low if low == high else mean for low, high, mean in found]
    return [0.0 if v is None or not math.isfinite(v) else v for v in middle]


def _correlate(
    df: DataFrame, pairs: list[tuple[str, str, str, str]], out: str, known_centres: dict[str, float] | None = None
) -> DataFrame:
    """(pair, col_a, col_b, n, out) for pairs of (name, name, column, column): Pearson of the columns.

    One pass for a middle value of each column, unless it is known, and one for the sums of all pairs around those values, over the
    rows where both values of a pair are present. A task sends one row of six sums for each pair.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p[2:]))
    place = {c: i for i, c in enumerate(columns)}
    centres = _centres(df, columns) if known_centres is None else [known_centres[c] for c in columns]
    named = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    wanted = [(place[x], place[y]) for _, _, x, y in pairs]
    moments = named.mapInArrow(
        _moment_rows(named.columns, centres, wanted), "pair int, " + ", ".join(f"{m} double" for m in MOMENTS)
    )
    sums = moments.groupBy("pair").agg(*[F.sum(m).alias(m) for m in MOMENTS])
    n = F.nullif(F.col("n"), F.lit(0.0))
    # what rounding leaves of a column without spread is no spread
    spread_x, spread_y = (
        F.when(F.col(q) - F.col(s) * F.col(s) / n > 1e-11 * F.col(q), F.col(q) - F.col(s) * F.col(s) / n)
        for s, q in (("sx", "sxx"), ("sy", "syy"))
    )
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread_x * spread_y)
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(pairs)], "pair int, col_a string, col_b string")
    return names.join(F.broadcast(sums), "pair", "left").select(
        "pair", "col_a", "col_b", F.coalesce("n", F.lit(0.0)).cast("bigint").alias("n"),
        F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias(out),
    )


# A rank table of up to this many distinct values is broadcast (about 100 bytes each in memory); at most so many tables and values in a job.
FEW_VALUES = 1_000_000
TABLES_PER_JOB = 24
# Up to so many larger rank tables are joined to the rows in turn; more are looked up for all columns in one join, which shuffles cells twice.
JOINED_IN_TURN = 3
VALUES_PER_JOB = 2_000_000

EMPTY_PAIRS = "pair int, col_a string, col_b string, n bigint, {} double"


def pearson(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Linear correlation of column pairs over the rows where both are present."""
    if not pairs:
        return df.sparkSession.createDataFrame([], EMPTY_PAIRS.format("pearson_r"))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    numbers = df.select(*[present(df, c).cast("double").alias(c) for c in used])
    return _correlate(numbers, [(a, b, a, b) for a, b in pairs], "pearson_r")


def _together_rows(names: list[str]):
    """Rows of a task in which two columns are both present, for every two of `names`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(names), len(names)))
        for batch in batches:
            there = np.column_stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in names]).astype(float)
            n += there.T @ there
        i, j = np.indices(n.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(n.ravel().astype(np.int64))],
            ["i", "j", "n"],
        )

    return rows


def rows_together(df: DataFrame, columns: list[str]) -> dict[Pair, int]:
    """In how many rows both columns of a pair are present, for all pairs at once; (c, c) is the count of c."""
    if not columns:
        return {}
    named = df.select(*[present(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = named.mapInArrow(_together_rows(named.columns), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    return {(columns[r["i"]], columns[r["j"]]): r["n"] for r in found.collect()}


def gap_views(pairs: list[Pair], together: dict[Pair, int]) -> tuple[dict[tuple[str, str | None], str], list[tuple[str, str]]]:
    """Which rankings the pairs need: names by (column, column whose gaps take rows away), and the two names of each pair.

    Only gaps of the partner take rows from a column, and none do where the column has those gaps itself. Partners whose gaps are the same
    rows stand for one another: two columns have the same gaps if each is present as often as both are together.
    """
    stands_for: dict[str, str] = {}
    for c in dict.fromkeys(a for a, _ in together):
        same = (o for o in dict.fromkeys(stands_for.values()) if together[c, o] == together[c, c] == together[o, o])
        stands_for[c] = next(same, c)
    ranked: dict[tuple[str, str | None], str] = {}

    def view(c: str, partner: str) -> str:
        other = stands_for.get(partner)
        if other is not None and c in stands_for and together[c, other] == together[c, c]:
            other = None
        return ranked.setdefault((c, other), f"v{len(ranked)}")

    names = [(view(a, b), view(b, a)) for a, b in pairs]
    return ranked, names


def spearman(
    df: DataFrame, pairs: list[Pair], columns_with_gaps: set[str] | None = None
) -> DataFrame:
    """Rank correlation of column pairs, average ranks for ties, over complete pairs.

    A column is ranked through its value counts, so ties are never gathered. Ranks of columns
    with few distinct values (counted first) are broadcast. A few other columns get their ranks in
    a join by value each; more are unfolded into (row, column, value), get their ranks in one join
    and are folded back by row. Columns without gaps are ranked once. Beside a partner with gaps a column is ranked over its
    rows without those; partners with the same gaps share that ranking (`gap_views`). All rankings of a column
    come from one count and one lookup of its values.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], EMPTY_PAIRS.format("spearman_r"))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    numbers = df.select(*[present(df, c).cast("double").alias(c) for c in used])
    if columns_with_gaps is None:
        found = numbers.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in used]).first()
        columns_with_gaps = {c for c, n in zip(used, found[1:]) if n < found[0]}

    ranked, view_names = gap_views(pairs, rows_together(numbers, [c for c in used if c in columns_with_gaps]))
    views = [(a, b, x, y) for (a, b), (x, y) in zip(pairs, view_names)]
    place = {c: f"b{i}" for i, c in enumerate(used)}
    # the rankings of a column, each over the rows that one other column has (None: over all of its own)
    kinds = [[other for c, other in ranked if c == own] for own in used]
    others = list(dict.fromkeys(o for own in kinds for o in own if o is not None))
    width = max(len(own) for own in kinds)
    wide = spread(numbers).select(*[col(c).alias(place[c]) for c in used])

    def unfolded(frame: DataFrame, keep: list[str], indexes: list[int]) -> DataFrame:
        """(keep, column, value), without missing values; `column` is the place in `indexes`."""
        return frame.select(*keep, F.posexplode(F.array(*[f"b{i}" for i in indexes])).alias("column", "value")).where(F.col("value").isNotNull())

    every = list(range(len(used)))
    present_at = F.array(F.lit(True), *[F.col(place[o]).isNotNull() for o in others])
    cells = unfolded(wide.select("*", present_at.alias("there")), ["there"], every)

    def counted(k: int) -> Column:
        at = [0 if k < len(own) and own[k] is None else others.index(own[k]) + 1 if k < len(own) else None for own in kinds]
        return F.count_if(F.get("there", F.get(F.lit(at).cast("array<int>"), F.col("column"))))

    tallies = [f"n{k}" for k in range(width)]
    counts = cells.groupBy("column", "value").agg(*[counted(k).alias(n) for k, n in enumerate(tallies)])
    ranks = cut_lineage(
        running_totals(counts, "column", "value", tallies)
        .select("column", "value", *tallies, *[(F.col(f"before_{n}") + (F.col(n) + 1) / 2).alias(f"r{k}") for k, n in enumerate(tallies)])
    )
    sizes = {r["column"]: r for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("size"), *[F.sum(n).alias(n) for n in tallies]).collect()}
    n_values = {i: sizes[i]["size"] if i in sizes else 0 for i in every}
    few = [i for i in every if n_values[i] <= FEW_VALUES]
    many = [i for i in every if i not in few]
    frame, held, tables = wide, 0, 0
    for i in few:
        if tables and (tables == TABLES_PER_JOB or held + n_values[i] > VALUES_PER_JOB):
            frame, held, tables = cut_lineage(frame), 0, 0
        held, tables = held + n_values[i], tables + 1
        own = [F.col(f"r{k}").alias(f"rank_{i}_{k}") for k in range(len(kinds[i]))]
        table = ranks.where(F.col("column") == i).select(F.col("value").alias("__value"), *own)
        frame = frame.join(F.broadcast(table), F.col(f"b{i}") == F.col("__value"), "left").drop("__value", *([] if used[i] in others else [f"b{i}"]))
    if len(many) <= JOINED_IN_TURN:
        for i in many:
            own = [F.col(f"r{k}").alias(f"rank_{i}_{k}") for k in range(len(kinds[i]))]
            table = ranks.where(F.col("column") == i).select(F.col("value").alias("__value"), *own)
            frame = frame.join(table, F.col(f"b{i}") == F.col("__value"), "left").drop("__value", *([] if used[i] in others else [f"b{i}"]))
    else:
        # the row number must not change when a task runs again
        frame = cut_lineage(frame.withColumn("row", F.monotonically_increasing_id()))
        kept = [f"b{i}" for i in many if used[i] not in others]
        folded = (
            unfolded(frame, ["row"], many)
            .withColumn("column", F.get(F.lit(many), F.col("column")))
            .join(ranks, ["column", "value"])
            .groupBy("row")
            .agg(
                *[
                    F.max(F.when(F.col("column") == i, F.col(f"r{k}"))).alias(f"rank_{i}_{k}")
                    for i in many for k in range(len(kinds[i]))
                ]
            )
        )
        frame = frame.drop(*kept).join(folded, "row", "left")
    looked_up, middles = [], {}
    for (c, other), name in ranked.items():
        i = used.index(c)
        k = kinds[i].index(other)
        rank = F.col(f"rank_{i}_{k}")
        looked_up.append((rank if other is None else F.when(F.col(place[other]).isNotNull(), rank)).alias(name))
        # average ranks of n values have the mean (n + 1) / 2, which is the only rank of a column without spread
        middles[name] = ((sizes[i][f"n{k}"] if i in sizes else 0) + 1) / 2
    return _correlate(frame.select(*looked_up), views, "spearman_r", middles)


FINDING = {
    "detector": "int", "order_a": "int", "order_b": "int", "finding_type": "string", "col_a": "string",
    "col_b": "string", "score": "double", "strength": "string", "direction": "string", "pearson_r": "double",
    "spearman_r": "double", "nonlinear": "boolean", "highest": "string", "lowest": "string",
    "spread_ratio": "double", "skew": "double", "top_level": "string", "top_pct": "double", "needs_test": "boolean",
}


def _finding(detector: int, finding_type: str, score: Column, **values: Column) -> list[Column]:
    values = {
        "detector": F.lit(detector), "finding_type": F.lit(finding_type), "score": F.round(score, 4),
        "strength": strength(score), **values,
    }
    return [(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in FINDING.items()]


def _gaps(profile: Profile) -> set[str]:
    return {r["column"] for r in profile.rows if r["n_missing"] > 0}


def _order(profile: Profile, c: Column) -> Column:
    pairs = [x for r in profile.rows for x in (F.lit(r["column"]), F.lit(r["position"]))]
    return F.create_map(*pairs)[c]


def correlations(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """Both coefficients of every numeric pair."""
    profile = profile_of(df, profile)
    pairs = all_pairs(profile.columns(*NUMERIC_TYPES))
    r = pearson(df, pairs)
    rho = spearman(df, pairs, _gaps(profile)).select("pair", "spearman_r")
    return r.join(F.broadcast(rho), "pair")


def correlation_findings(
    df: DataFrame, profile: Profile | None = None, min_abs_r: float = 0.3, both: DataFrame | None = None
) -> DataFrame:
    """Correlated pairs of numbers; `both` is what `correlations` found, if it is known."""
    profile = profile_of(df, profile)
    both = (correlations(df, profile) if both is None else both).where("pearson_r IS NOT NULL AND spearman_r IS NOT NULL")
    score = F.greatest(F.abs("pearson_r"), F.abs("spearman_r"))
    return both.where(score >= min_abs_r).select(
        *_finding(
            0, "correlation", score, order_a=_order(profile, F.col("col_a")), order_b=_order(profile, F.col("col_b")),
            col_a=F.col("col_a"), col_b=F.col("col_b"),
            direction=F.when(F.col("pearson_r") >= 0, "positive").otherwise("negative"),
            pearson_r=F.round("pearson_r", 4), spearman_r=F.round("spearman_r", 4),
            nonlinear=F.abs("spearman_r") - F.abs("pearson_r") >= 0.2, needs_test=F.lit(True),
        )
    )


def group_means(df: DataFrame, measures: list[str], groups: list[str]) -> DataFrame:
    """(group_column, level, measure, size, n, mean, variance) for every grouping column at once.

    `size` counts the rows of the level, `n` those with the measure present. A row is unfolded
    into one row per grouping column and summed up before the shuffle.
    """
    if not measures or not groups:
        return df.sparkSession.createDataFrame(
            [], "group_column string, level string, measure string, size bigint, n bigint, mean double, variance double"
        )
    base = df.select(
        *[present(df, m).cast("double").alias(f"m{i}") for i, m in enumerate(measures)],
        *[present(df, g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)],
    )
    names = [f"m{i}" for i in range(len(measures))]
    unfolded = base.select(
        *names,
        F.inline(
            F.array(*[F.struct(F.lit(g).alias("group_column"), F.col(f"g{i}").alias("level")) for i, g in enumerate(groups)])
        ),
    ).where(F.col("level").isNotNull())
    wide = unfolded.groupBy("group_column", "level").agg(
        F.count(F.lit(1)).alias("size"),
        *[
            F.struct(
                F.lit(measures[i]).alias("measure"), F.count(m).alias("n"), F.avg(m).alias("mean"),
                F.var_samp(m).alias("variance"),
            ).alias(m)
            for i, m in enumerate(names)
        ],
    )
    return wide.select("group_column", "level", "size", F.inline(F.array(*names))).select(
        "group_column", "level", "measure", "size", "n", "mean", "variance"
    )


def group_spread(df: DataFrame, measures: list[str], groups: list[str]) -> DataFrame:
    """Per (measure, group_column): weighted spread of the group means over the overall std."""
    means = group_means(df, measures, groups)
    if not measures or not groups:
        return df.sparkSession.createDataFrame(
            [], "measure string, group_column string, n_groups bigint, spread double, highest string, lowest string"
        )
    overall = (
        df.select(*[present(df, m).cast("double").alias(m) for m in measures])
        .unpivot([], [col(m) for m in measures], "measure", "value")
        .groupBy("measure")
        .agg(F.avg("value").alias("grand"), F.stddev_samp("value").alias("std"))
    )
    joined = means.join(F.broadcast(overall), "measure").where("std > 0")
    gap = F.col("size") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))
    known = F.col("mean").isNotNull()
    return (
        joined.groupBy("measure", "group_column")
        .agg(
            F.count("mean").alias("n_groups"),
            (F.sqrt(F.sum(gap) / F.sum("size")) / F.first("std")).alias("spread"),
            # the smaller label wins a tie
            F.min_by("level", F.when(known, F.struct(-F.col("mean"), F.col("level")))).alias("highest"),
            F.min_by("level", F.when(known, F.struct(F.col("mean"), F.col("level")))).alias("lowest"),
        )
        .where("n_groups >= 2")
    )


def groups_of(profile: Profile, max_levels: int = 20) -> list[str]:
    """Label-like columns of few levels."""
    return [g for g in profile.columns(*GROUP_TYPES) if profile.named(g)["n_unique"] <= max_levels]


def group_difference_findings(
    df: DataFrame, profile: Profile | None = None, min_score: float = 0.3, max_levels: int = 20, spreads: DataFrame | None = None
) -> DataFrame:
    """Numbers that differ between groups; `spreads` is what `group_spread` found for these groups and perhaps others, if it is known."""
    profile = profile_of(df, profile)
    measures = profile.columns(*NUMERIC_TYPES)
    groups = groups_of(profile, max_levels)
    spread = group_spread(df, measures, groups) if spreads is None else spreads.where(F.col("group_column").isin(groups))
    score = F.least(F.lit(1.0), F.round("spread", 4))
    return spread.where(score >= min_score).select(
        *_finding(
            1, "group_difference", score, order_a=_order(profile, F.col("group_column")),
            order_b=_order(profile, F.col("measure")), col_a=F.col("measure"), col_b=F.col("group_column"),
            highest=F.col("highest"), lowest=F.col("lowest"), spread_ratio=F.round("spread", 4), needs_test=F.lit(True),
        )
    )


def skew_findings(profile: DataFrame, min_abs_skew: float = 1.0) -> DataFrame:
    size = F.abs("skew")
    score = F.least(F.lit(1.0), size / 3.0)
    return profile.where(F.col("semantic_type").isin(*NUMERIC_TYPES) & (size >= min_abs_skew)).select(
        *_finding(
            2, "distribution_skew", score, order_a=F.col("position"), order_b=F.lit(0), col_a=F.col("column"),
            direction=F.when(F.col("skew") > 0, "right").otherwise("left"), skew=F.col("skew"), needs_test=F.lit(False),
        )
    )


def dominant_findings(profile: DataFrame, dominance_pct: float = 90.0) -> DataFrame:
    leader = F.col("top_values")[0]
    top_pct = leader["n"] * 100.0 / (F.col("n_total") - F.col("n_missing"))
    score = F.least(F.lit(1.0), (top_pct - 50.0) / 50.0)
    return profile.where(F.col("semantic_type").isin(*GROUP_TYPES) & (top_pct >= dominance_pct)).select(
        *_finding(
            3, "dominant_category", score, order_a=F.col("position"), order_b=F.lit(0), col_a=F.col("column"),
            top_level=leader["value"], top_pct=F.round(top_pct, 2), needs_test=F.lit(False),
        )
    )


def target_findings(
    df: DataFrame, target: str, profile: Profile | None = None, min_score: float = 0.25, both: DataFrame | None = None,
    spreads: DataFrame | None = None,
) -> DataFrame:
    """Features related to a target: by rank correlation, or by the spread over its classes.

    `both` is what `correlations` found; it holds the rank correlations with the target too. `spreads` is what
    `group_spread` found for the target and perhaps other groups.
    """
    profile = profile_of(df, profile)
    row = profile.named(target)
    numeric = [c for c in profile.columns(*NUMERIC_TYPES) if c != target]
    empty = df.sparkSession.createDataFrame([], ", ".join(f"{k} {t}" for k, t in FINDING.items()))
    if row is None:
        return empty
    if row["semantic_type"] in NUMERIC_TYPES:
        if both is None:
            rho = spearman(df, [(c, target) for c in numeric], _gaps(profile))
        else:
            other = F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a"))
            rho = both.where((F.col("col_a") == target) | (F.col("col_b") == target)).withColumn("col_a", other)
        score = F.abs("spearman_r")
        return rho.where(score >= min_score).select(
            *_finding(
                4, "target_relationship", score, order_a=_order(profile, F.col("col_a")), order_b=F.lit(0),
                col_a=F.col("col_a"), col_b=F.lit(target),
                direction=F.when(F.col("spearman_r") >= 0, "positive").otherwise("negative"),
                spearman_r=F.round("spearman_r", 4), needs_test=F.lit(True),
            )
        )
    if row["semantic_type"] in GROUP_TYPES:
        spread = group_spread(df, numeric, [target]) if spreads is None else spreads.where(F.col("group_column") == target)
        score = F.least(F.lit(1.0), F.round("spread", 4))
        return spread.where(score >= min_score).select(
            *_finding(
                4, "target_relationship", score, order_a=_order(profile, F.col("measure")), order_b=F.lit(0),
                col_a=F.col("measure"), col_b=F.lit(target), highest=F.col("highest"), lowest=F.col("lowest"),
                spread_ratio=F.round("spread", 4), needs_test=F.lit(True),
            )
        )
    return empty


def findings(
    df: DataFrame, target: str | None = None, profile: Profile | None = None, both: DataFrame | None = None
) -> DataFrame:
    """Everything that stands out, strongest first; `both` is what `correlations` found, if it is known."""
    profile = profile_of(df, profile)
    both = cut_lineage(correlations(df, profile)) if both is None else both
    groups = groups_of(profile)
    if target in profile.columns(*GROUP_TYPES) and target not in groups:
        groups.append(target)
    spreads = cut_lineage(group_spread(df, profile.columns(*NUMERIC_TYPES), groups))
    parts = [
        correlation_findings(df, profile, both=both),
        group_difference_findings(df, profile, spreads=spreads),
        skew_findings(profile.frame),
        dominant_findings(profile.frame),
    ]
    if target is not None:
        parts.append(target_findings(df, target, profile, both=both, spreads=spreads))
    return ranked_findings(union_all(parts))


def ranked_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), "detector", "order_a", "order_b")


def top_findings(found: DataFrame, k: int = 5) -> DataFrame:
    return ranked_findings(found).limit(k)


def findings_of_type(found: DataFrame, finding_type: str) -> DataFrame:
    return found.where(F.col("finding_type") == finding_type)


def finding_counts(found: DataFrame, by: str = "finding_type") -> DataFrame:
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("n_findings"))
