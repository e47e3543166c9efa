"""Connected components of links between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, label): the smallest node that each node of `nodes` reaches by `links` (low, high).

    Alternates two steps until nothing changes: every node sends its larger neighbours, then its smaller ones,
    to the smallest neighbour it knows. Trees flatten to stars in a number of rounds that
    grows with the logarithm of their size; a round joins and groups by node, and its links are
    written, so neither driver nor plan holds them.
    """

    def around(edges: DataFrame) -> DataFrame:
        return edges.union(edges.select("high", "low")).toDF("node", "other")

    def step(edges: DataFrame, larger: bool) -> DataFrame:
        pairs = around(edges) if larger else edges.select(F.greatest("low", "high").alias("node"), F.least("low", "high").alias("other"))
        least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"))
        moved = pairs.join(least, "node").where("other > node" if larger else "other <> root").select(
            F.col("root").alias("low"), F.col("other").alias("high")
        )
        out = moved if larger else moved.union(least.select(F.col("root").alias("low"), F.col("node").alias("high")))
        return out.where("low <> high").distinct()

    edges = cut_lineage(links.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).where("low <> high").distinct())
    summary, before = None, ()
    while summary != before:
        before = summary
        edges = cut_lineage(step(step(edges, True), False))
        row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first()
        summary = (row[0], row[1])
    # each node now hangs on its root
    roots = edges.groupBy("high").agg(F.min("low").alias("low"))
    return cut_lineage(
        nodes.join(roots, nodes["cls"] == roots["high"], "left").select("cls", F.coalesce("low", "cls").alias("label"))
    )
