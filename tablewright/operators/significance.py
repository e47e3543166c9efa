"""Which patterns hold up: correlation, group and contingency tests with effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import col, effect_label, present
from ..functions.tails import tail_probability
from ..session import cut_lineage
from .frequency import union_all
from .patterns import Pair, correlations, findings, group_means, pearson, spearman
from .profile import GROUP_TYPES, NUMERIC_TYPES, Profile, profile_of

MIN_PAIRS = 8
MIN_GROUP_ROWS = 5
MIN_EXPECTED = 5

TEST = {
    "test_kind": "string", "col_a": "string", "col_b": "string", "n": "bigint", "k": "bigint", "statistic": "double",
    "tail": "string", "dof1": "double", "dof2": "double", "effect_metric": "string", "effect_value": "double",
    "spearman_r": "double", "curved": "boolean", "small_expected": "boolean", "min_expected": "double",
    "first_group": "string", "second_group": "string", "first_mean": "double", "second_mean": "double",
}
TEST_SCHEMA = ", ".join(f"{k} {t}" for k, t in TEST.items())


def _test(**values: Column) -> list[Column]:
    return [(values[k] if k in values else F.lit(None)).cast(t).alias(k) for k, t in TEST.items()]


def correlation_tests(df: DataFrame, pairs: list[Pair], known: DataFrame | None = None) -> DataFrame:
    """Pearson test of column pairs; the rank coefficient rides along.

    `known` is what `correlations` found for these pairs and perhaps others, each pair once and in either order.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA)
    if known is None:
        both = pearson(df, pairs).join(F.broadcast(spearman(df, pairs).select("pair", "spearman_r")), "pair")
    else:
        wanted = df.sparkSession.createDataFrame(pairs, "col_a string, col_b string")
        same = F.array_sort(F.array("col_a", "col_b"))
        # one row for each pair
        both = wanted.withColumn("same", same).join(F.broadcast(known.withColumn("same", same).drop("col_a", "col_b")), "same")
    enough = F.col("n") >= MIN_PAIRS
    r, dof = F.col("pearson_r"), F.col("n") - 2
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(
        r * F.sqrt(dof / F.when(F.abs(r) < 1, 1 - r * r))
    )
    return both.select(
        *_test(
            test_kind=F.lit("pearson_correlation"), col_a=F.col("col_a"), col_b=F.col("col_b"), n=F.col("n"),
            statistic=F.when(enough, r), tail=F.lit("t"), dof1=F.when(enough, dof), dof2=F.when(enough, t),
            effect_metric=F.when(enough, "pearson_r"), effect_value=F.when(enough, r),
            spearman_r=F.when(enough, F.col("spearman_r")),
            curved=F.when(enough, F.abs("spearman_r") - F.abs(r) > 0.15),
        )
    )


def group_tests(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Welch t (two groups) or one-way ANOVA (more) of (measure, group column) pairs.

    Everything follows from count, mean and variance per group; only groups of at least five
    complete rows take part.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA)
    measures = list(dict.fromkeys(m for m, _ in pairs))
    groups = list(dict.fromkeys(g for _, g in pairs))
    wanted = df.sparkSession.createDataFrame(pairs, "measure string, group_column string")
    keys = ["measure", "group_column"]
    levels = group_means(df, measures, groups).where(F.col("n") >= MIN_GROUP_ROWS).join(F.broadcast(wanted), keys)
    grand = levels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    gap = F.col("mean") - F.col("grand")
    # the two-group case needs its two rows side by side, larger group first; longer lists stay empty
    sums = (
        # one row per pair
        levels.join(F.broadcast(grand), keys)
        .groupBy(*keys)
        .agg(
            F.first("k").alias("k"),
            F.first("total").alias("total"),
            F.sum(F.col("n") * gap * gap).alias("between"),
            F.sum((F.col("n") - 1) * F.col("variance")).alias("within"),
            F.array_sort(
                F.collect_list(F.when(F.col("k") == 2, F.struct((-F.col("n")).alias("o"), "level", "n", "mean", "variance")))
            ).alias("two"),
        )
    )
    every = wanted.join(F.broadcast(sums), keys, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    first, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    two, many = F.col("k") == 2, F.col("k") > 2

    v0, v1 = first["variance"] / first["n"], second["variance"] / second["n"]
    mean_gap = first["mean"] - second["mean"]
    spread = F.sqrt(v0 + v1)
    # without any spread, different means are certainly different
    t = F.when(spread > 0, mean_gap / F.nullif(spread, F.lit(0.0))).when(mean_gap != 0, F.signum(mean_gap) * F.lit(float("inf")))
    welch = F.coalesce(
        (v0 + v1) * (v0 + v1) / F.nullif(v0 * v0 / (first["n"] - 1) + v1 * v1 / (second["n"] - 1), F.lit(0.0)),
        F.when(mean_gap != 0, (first["n"] + second["n"] - 2).cast("double")),
    )
    pooled = F.sqrt(
        ((first["n"] - 1) * first["variance"] + (second["n"] - 1) * second["variance"]) / (first["n"] + second["n"] - 2)
    )
    d = F.when(pooled > 0, -mean_gap / F.nullif(pooled, F.lit(0.0))).otherwise(0.0)

    between, within = F.col("between"), F.col("within")
    dof_b, dof_w = F.col("k") - 1, F.col("total") - F.col("k")
    f = F.when(within > 0, (between / dof_b) / F.nullif(within / dof_w, F.lit(0.0))).when(between > 0, F.lit(float("inf")))
    eta = F.when(between + within > 0, between / F.nullif(between + within, F.lit(0.0))).otherwise(0.0)
    return every.select(
        *_test(
            test_kind=F.when(many, "anova").otherwise("t_test"), col_a=F.col("measure"), col_b=F.col("group_column"),
            n=F.col("total"), k=F.col("k"), statistic=F.when(two, t).when(many, f),
            tail=F.when(two, "t").when(many, "f"), dof1=F.when(two, welch).when(many, dof_b.cast("double")),
            dof2=F.when(two, t).when(many, dof_w.cast("double")),
            effect_metric=F.when(two, "cohens_d").when(many, "eta_squared"), effect_value=F.when(two, d).when(many, eta),
            first_group=F.when(two, first["level"]), second_group=F.when(two, second["level"]),
            first_mean=F.when(two, first["mean"]), second_mean=F.when(two, second["mean"]),
        )
    )


def cell_counts(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """(pair, a, b, n): observed cells of many contingency tables, in one shuffle."""
    used = list(dict.fromkeys(c for p in pairs for c in p))
    text = df.select(*[present(df, c).cast("string").alias(f"c{i}") for i, c in enumerate(used)])
    place = {c: f"c{i}" for i, c in enumerate(used)}
    return (
        text.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("pair"), F.col(place[a]).alias("a"), F.col(place[b]).alias("b"))
                        for i, (a, b) in enumerate(pairs)
                    ]
                )
            )
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: A full contingency table is formed in at least LEAST_BLOCKS squared blocks of about CELLS_PER_BLOCK cells or fewer.
LEAST_BLOCKS, CELLS_PER_BLOCK = 8, 1_000_000


def contingency_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with a row for every combination of levels, also the empty ones.

    This is the full table a reader asks for; `chi_square_tests` needs the observed cells alone. The levels of both
    sides are dealt into buckets by their hash and joined by pairs of buckets, so the cells are formed in as many
    tasks as the table's size asks for, whichever side has the many levels.
    """
    cells = cut_lineage(cell_counts(df, [(a, b)]).select("a", "b", "n"))
    rows, columns = (cut_lineage(cells.select(c).distinct()) for c in ("a", "b"))
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(rows.count() * columns.count() / CELLS_PER_BLOCK)))

    def dealt(levels: DataFrame, level: str, own: str, other: str) -> DataFrame:
        bucket, zero = F.pmod(F.xxhash64(level), F.lit(blocks)), F.lit(0).cast("bigint")
        return levels.select(level, bucket.alias(own), F.explode(F.sequence(zero, zero + (blocks - 1))).alias(other))

    every = dealt(rows, "a", "row_block", "column_block").join(dealt(columns, "b", "column_block", "row_block"), ["row_block", "column_block"])
    return every.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def expected_counts(table: DataFrame) -> DataFrame:
    """A contingency table with its margins and the counts expected under independence."""
    rows = table.groupBy("a").agg(F.sum("n").alias("row_total"))
    columns = table.groupBy("b").agg(F.sum("n").alias("column_total"))
    total = table.agg(F.sum("n").alias("total")).first()["total"]
    return (
        table.join(rows, "a").join(columns, "b").withColumn("total", F.lit(total))
        .withColumn("expected", F.col("row_total") * F.col("column_total") / F.col("total"))
        .select("a", "b", "n", "row_total", "column_total", "total", "expected")
    )


def chi_square_tests(df: DataFrame, pairs: list[Pair]) -> DataFrame:
    """Chi-square test of independence with the Yates correction for 2 x 2 tables.

    Only observed cells are counted. An empty cell adds its expected count, and all expected
    counts add up to n, so the empty ones add n less the expected counts of the observed cells.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], TEST_SCHEMA)
    cells = cell_counts(df, pairs)
    rows = cells.groupBy("pair", "a").agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy("pair", "b").agg(F.sum("n").alias("column_total"))
    row_side = rows.groupBy("pair").agg(
        F.count_if(F.col("row_total") > 0).alias("n_rows"), F.sum("row_total").alias("total"),
        F.min("row_total").alias("least_row"), F.sum(1.0 / F.col("row_total")).alias("inverse_rows"),
    )
    column_side = columns.groupBy("pair").agg(
        F.count_if(F.col("column_total") > 0).alias("n_columns"), F.min("column_total").alias("least_column"),
        F.sum(1.0 / F.col("column_total")).alias("inverse_columns"),
    )
    margins = row_side.join(F.broadcast(column_side), "pair")
    expected = F.col("row_total") * F.col("column_total") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    sums = (
        cells.join(rows, ["pair", "a"]).join(columns, ["pair", "b"])
        .join(F.broadcast(row_side.select("pair", "total")), "pair")
        .groupBy("pair")
        .agg(F.sum(gap * gap / expected).alias("observed_part"), F.sum(expected).alias("observed_expected"), F.max(gap).alias("gap"))
    )
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col_a string, col_b string")
    joined = names.join(F.broadcast(margins), "pair", "left").join(F.broadcast(sums), "pair", "left")
    usable = (F.col("n_rows") >= 2) & (F.col("n_columns") >= 2)
    dof = (F.col("n_rows") - 1) * (F.col("n_columns") - 1)
    # in a 2 x 2 table all four gaps are equal
    corrected = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = corrected * corrected * F.col("total") * F.col("inverse_rows") * F.col("inverse_columns")
    plain = F.col("observed_part") + F.col("total") - F.col("observed_expected")
    chi2 = F.when(dof == 1, yates).otherwise(plain)
    smaller = F.least(F.col("n_rows"), F.col("n_columns")) - 1
    least = F.col("least_row") * F.col("least_column") / F.col("total")
    return joined.select(
        *_test(
            test_kind=F.lit("chi_square"), col_a=F.col("col_a"), col_b=F.col("col_b"), n=F.col("total"),
            statistic=F.when(usable, chi2), tail=F.lit("chi2"), dof1=F.when(usable, dof.cast("double")),
            effect_metric=F.when(usable, "cramers_v"),
            effect_value=F.when(usable, F.sqrt(chi2 / F.nullif(F.col("total") * smaller, F.lit(0)))),
            small_expected=F.when(usable, least < MIN_EXPECTED), min_expected=F.when(usable, least),
        )
    )


def with_p_values(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value, effect word and verdict; tests without a statistic are inconclusive.

    For t tests `dof2` carries the unrounded t value, as the reported statistic of a
    correlation is r.
    """
    is_t = F.col("tail") == "t"
    statistic = F.when(is_t, F.col("dof2")).otherwise(F.col("statistic"))
    p = tail_probability(
        F.coalesce("tail", F.lit("")), statistic, F.col("dof1"), F.when(~is_t, F.col("dof2"))
    )
    judged = tests.withColumn("p_value", p)
    return judged.withColumn("effect_size", effect_label(F.col("effect_metric"), F.col("effect_value"))).withColumn(
        "significance",
        # a test that ran but has no p-value reads as not significant
        F.when(F.col("effect_metric").isNull(), "inconclusive")
        .when(F.col("p_value") < alpha, "significant")
        .otherwise("not_significant"),
    ).withColumn("dof2", F.when(~is_t, F.col("dof2")))


def chosen_tests(found: DataFrame, profile: DataFrame) -> DataFrame:
    """(seq, test_kind, col_a, col_b): the test each finding calls for, each test once."""
    kinds = profile.select(F.col("column"), F.col("semantic_type"))
    a = kinds.select(F.col("column").alias("col_a"), F.col("semantic_type").alias("type_a"))
    b = kinds.select(F.col("column").alias("col_b"), F.col("semantic_type").alias("type_b"))
    # findings are at most one per pair of columns and detector
    order = Window.orderBy(F.desc("score"), "detector", "order_a", "order_b")
    typed = (
        found.where("needs_test").withColumn("seq", F.row_number().over(order))
        .join(F.broadcast(a), "col_a").join(F.broadcast(b), "col_b")
    )
    num_a, num_b = F.col("type_a").isin(*NUMERIC_TYPES), F.col("type_b").isin(*NUMERIC_TYPES)
    cat_a, cat_b = F.col("type_a").isin(*GROUP_TYPES), F.col("type_b").isin(*GROUP_TYPES)
    swap = cat_a & num_b
    kind = (
        F.when((F.col("finding_type") == "correlation") | (num_a & num_b), "correlation")
        .when((num_a & cat_b) | swap, "group_difference")
        .when(cat_a & cat_b, "chi_square")
    )
    named = typed.select(
        "seq", kind.alias("test_kind"), F.when(swap, F.col("col_b")).otherwise(F.col("col_a")).alias("col_a"),
        F.when(swap, F.col("col_a")).otherwise(F.col("col_b")).alias("col_b"),
    ).where("test_kind IS NOT NULL")
    return each_test_once(named)


def each_test_once(tests: DataFrame) -> DataFrame:
    """Keep the first of the tests of one kind on the same two columns, in either order."""
    same = Window.partitionBy("test_kind", F.array_sort(F.array("col_a", "col_b"))).orderBy("seq")
    return tests.withColumn("__again", F.row_number().over(same)).where("__again = 1").drop("__again")


def target_pairs(profile: Profile, target: str | None) -> list[Pair]:
    """Every label-like column against a label-like target."""
    row = profile.named(target) if target else None
    if row is None or row["semantic_type"] not in GROUP_TYPES:
        return []
    return [(c, target) for c in profile.columns(*GROUP_TYPES) if c != target]


def significance_tests(
    df: DataFrame,
    target: str | None = None,
    profile: Profile | None = None,
    found: DataFrame | None = None,
    alpha: float = 0.05,
) -> DataFrame:
    """Test every finding, and every label-like column against a label-like target."""
    profile = profile_of(df, profile)
    known = None
    if found is None:
        # the coefficients that the findings come from are those of the tests
        known = cut_lineage(correlations(df, profile))
        found = findings(df, target, profile, known)
    plan = [(r["seq"], r["test_kind"], r["col_a"], r["col_b"]) for r in chosen_tests(found, profile.frame).collect()]
    last = max([p[0] for p in plan], default=0)
    extra = [(last + i + 1, "chi_square", a, b) for i, (a, b) in enumerate(target_pairs(profile, target))]
    planned = {(k, frozenset((a, b))) for _, k, a, b in plan}
    plan += [p for p in extra if (p[1], frozenset(p[2:])) not in planned]

    def of(kind: str) -> list[Pair]:
        return [(a, b) for _, k, a, b in plan if k == kind]

    tests = union_all(
        [correlation_tests(df, of("correlation"), known), group_tests(df, of("group_difference")), chi_square_tests(df, of("chi_square"))]
    )
    family = F.when(F.col("test_kind") == "pearson_correlation", "correlation").when(
        F.col("test_kind") == "chi_square", "chi_square"
    ).otherwise("group_difference")
    order = df.sparkSession.createDataFrame(plan, "seq int, family string, col_a string, col_b string")
    judged = with_p_values(tests, alpha).withColumn("family", family)
    return corrected_for_many(judged.join(F.broadcast(order), ["family", "col_a", "col_b"]).drop("family"), alpha, len(plan))


def corrected_for_many(tests: DataFrame, alpha: float, n_tests: int) -> DataFrame:
    """Bonferroni: every test counts, also the inconclusive ones."""
    threshold = F.lit(alpha / n_tests if n_tests else None).cast("double")
    return tests.withColumn("bonferroni_alpha", threshold).withColumn(
        "survives", F.coalesce((F.col("significance") == "significant") & (F.col("p_value") < threshold), F.lit(False))
    )


def strongest_effect(tests: DataFrame) -> DataFrame:
    """The significant test with the largest absolute effect; the first one wins a tie."""
    return (
        tests.where("significance = 'significant' AND effect_value IS NOT NULL")
        .orderBy(F.desc(F.abs(F.round("effect_value", 4))), "seq").limit(1)
    )


def significant_tests(tests: DataFrame) -> DataFrame:
    return tests.where("significance = 'significant'")


def tests_of_kind(tests: DataFrame, kind: str) -> DataFrame:
    return tests.where(F.col("test_kind") == kind)
