"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import WORD

#: Times that a document can be served.
EPOCHS = 3


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _source(source_col: str) -> list[Column]:
    """A join key that a missing source has too."""
    return [F.col(source_col).isNull().alias("__none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__name")]


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """Weights for sources in code point order, a missing one last: the cycle, over and over.

    One task numbers the sources; there is one row for each, however large the corpus.
    """
    nth = F.row_number().over(Window.orderBy("__none", "__name")) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (nth % len(cycle) + 1).cast("int")))


def fair_targets(sources: DataFrame, budget: float, most: float = EPOCHS) -> DataFrame:
    """`sources` (source_size, weight) with the tokens each one gets.

    The budget is shared by weight. A source stops at `most` times its size, and what it leaves is
    shared again among the others until none is above. Each round reads one row of sums.
    """
    cap = F.col("source_size") * most
    level, full = 0.0, -1
    while True:
        stopped = F.col("weight") * level >= cap if full >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(stopped, cap).otherwise(0.0)).alias("caps"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(F.when(stopped, 1).otherwise(0)).alias("full"),
        ).first()
        if not row["open"]:  # every source is full, or there is none
            return sources.withColumn("target", cap.cast("double"))
        if row["full"] == full:
            return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap).cast("double"))
        level, full = (budget - row["caps"]) / row["open"], row["full"]


#: Columns that a mix adds.
ADDED = ("size", "source_size", "target", "virtual_finish", "copies", "taken", "weight")


def weighted_fair_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: DataFrame | None = None,
    share: float = 1.0,
    seed: int = 11,
    parts: int = 512,
    keep_text: bool = True,
) -> DataFrame:
    """`df` with size, source_size, target, virtual_finish, copies and taken.

    Each source is a queue of its documents in shuffled order, served `EPOCHS` times at most. The
    virtual finish time of a document is the number of its source's tokens up to its end, divided
    by the source's weight; serving by finish time gives every source its share at any moment. The
    stream ends at the time when the whole budget (`share` of all words) is spent, which for each
    source is its target; the document in service then is taken if more than half of it is
    through. So a source misses its target by half a document at most.

    `weights` has one row (source_col, weight) per source; without it weights are `cyclic_weights`.
    Running sums are formed within `parts` hash parts of a source and shifted by the parts before, so
    a source with a third of all rows is spread over as many tasks. The shuffled order depends on
    the id, the text and the seed alone; rows equal in both are interchangeable. Missing text has
    size 0, a missing source is a source, a missing id is an id. Columns of `df` that are named like an added
    one are replaced; an empty table gives an empty table.
    """
    sized = df.drop(*[c for c in ADDED if c not in (id_col, text_col, source_col)]).withColumns(
        {"size": word_count(text_col), "__at": F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))}
    )
    if not keep_text:
        sized = sized.select(id_col, source_col, "size", "__at")
    none, name = _source(source_col)
    # high bits choose the part, so parts in order are the shuffled order
    part = F.floor((F.shiftrightunsigned(F.col("__at"), 33)) * parts / 2**31).cast("int")
    sized = sized.withColumns({"__none": none, "__name": name, "__part": part})
    key = ["__none", "__name"]
    sums = cut_lineage(sized.groupBy(*key, "__part").agg(F.sum("size").alias("__sum")))
    sources = sums.groupBy(*key).agg(F.sum("__sum").alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(sources)
    else:
        weighted = sources.join(weights.select(*_source(source_col), F.col("weight").cast("double")), key)
    sources = cut_lineage(weighted)
    budget = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("__before", before).drop("__sum").join(fair_targets(sources, budget), key)
    inside = Window.partitionBy(*key, "__part").orderBy("__at", "size", id_col).rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("__before") + F.col("__inside")
    taken = sum(
        F.when(done + e * F.col("source_size") - F.col("size") / 2 <= F.col("target"), 1).otherwise(0) for e in range(EPOCHS)
    )
    return (
        sized.withColumn("__inside", F.sum("size").over(inside))
        .join(starts, [*key, "__part"])
        .withColumns({"virtual_finish": done / F.col("weight"), "copies": F.when(F.col("target") > 0, taken).otherwise(0)})
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("__at", "__inside", "__before", "__part", *key)
    )


def mixed_stream(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The documents in the order of service, each as often as it was taken.

    A global range sort by finish time; a later serving finishes by the source's whole size over
    its weight later.
    """
    return (
        mixed.where("copies > 0")
        .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .withColumn("__finish", F.col("virtual_finish") + F.col("__epoch") * F.col("source_size") / F.col("weight"))
        .orderBy("__finish", *[c for c in columns if c in ("source", "doc_id")])
        .select(*columns)
    )


def mixed_documents(df: DataFrame, **mix) -> DataFrame:
    """The stream of a mix with the columns of `df`, also of those that are named like an added one."""
    aside = {c: f"__own_{c}" for c in df.columns if c in ADDED}
    moved = df.withColumnsRenamed(aside)
    return mixed_stream(weighted_fair_mix(moved, **mix), moved.columns).withColumnsRenamed({v: k for k, v in aside.items()})
