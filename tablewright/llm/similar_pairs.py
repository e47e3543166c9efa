"""All pairs of similar sets within components, block by block, without a row for each pair on the way."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .filters import hash_filter, may_hold
from .tokens import texts_of

#: Shingles of a block: a task holds two blocks at a time. A set with more is a block of its own.
BLOCK = 1 << 18
KEY = ["label", "band", "up", "i", "j"]

#: The set of a text, as sorted hashes, and its prefix.
SetOf = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def blocks(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """The blocks that the sets of each component (`label`) are compared in.

    From (label, cls, n, ...) with sets of n shingles to the same rows with `places`: the pairs of blocks a set takes part in.
    A component of at most `block` shingles is one block. A larger one is cut into bands of set sizes so that similar
    sets lie in the same or in adjacent bands, and a band into hash buckets of about `block` shingles. So a set is copied once for each bucket
    near its size, not once for each partner.
    """
    # written, so that joins by label have shuffles of their own and a large component can be split
    totals = cut_lineage(members.groupBy("label").agg(F.count("*").alias("many"), F.sum("n").alias("total")).where("many > 1"))
    step = math.log(100 / percent * 1.0001)
    band = F.when(F.col("total") <= block, 0).otherwise(F.floor(F.log("n") / step)).cast("int")
    banded = cut_lineage(members.join(totals, "label").withColumn("band", band).drop("many", "total"))
    sizes = banded.groupBy("label", "band").agg(F.ceil(F.sum("n") / block).cast("int").alias("buckets"))
    line = Window.partitionBy("label").orderBy("band")  # a few hundred bands at most

    def beside(shift: int):
        near = F.lag if shift < 0 else F.lead
        return F.when(near("band").over(line) == F.col("band") + shift, near("buckets").over(line)).otherwise(0)

    sizes = cut_lineage(sizes.select("label", "band", "buckets", beside(-1).alias("below"), beside(1).alias("above")))
    mine = F.col("bucket")

    def place(band, up: int, i, j, side):
        return F.struct(band.alias("band"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"), side.alias("side"))

    def over(count: str, make):
        return F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(count) - 1)), make)).otherwise(F.array())

    own = over("buckets", lambda k: place(F.col("band"), 0, F.least(mine, k), F.greatest(mine, k), (mine > k).cast("int")))
    up = over("above", lambda k: place(F.col("band"), 1, mine, k, F.lit(0)))
    down = over("below", lambda k: place(F.col("band") - 1, 1, k, mine, F.lit(1)))
    return (
        banded.join(sizes, ["label", "band"]).withColumn("bucket", F.pmod(F.xxhash64("cls"), "buckets").cast("int"))
        .withColumn("places", F.concat(own, up, down)).drop("band", "buckets", "below", "above", "bucket")
    )


class Side:
    """Sets of a block in the order of their sizes."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (len(r[2]), r[0]))
        self.cls, self.copies = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.sets, self.prefixes = [r[2] for r in rows], [r[3] for r in rows]
        self.n = np.array([len(s) for s in self.sets], np.int64)


def similar(a: Side, b: Side, percent: int, fewest: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(place in a, places in b) of similar sets; with a block against itself each pair once.

    The sizes pick a range of b (length filter); sets of it that share `fewest` shingles of both prefixes are counted in full.
    """
    same = a is b
    sides = [a] if same else [a, b]
    _, ids = np.unique(np.concatenate([x for s in sides for x in s.sets]), return_inverse=True)
    mark = np.zeros(ids.max() + 1, bool)
    # a prefix is part of its set, so its numbers are found there
    numbered, at = [], 0
    for s in sides:
        sets = np.split(ids[at : at + s.n.sum()], np.cumsum(s.n)[:-1])
        at += s.n.sum()
        numbered.append((sets, [own[np.searchsorted(full, p)] for own, full, p in zip(sets, s.sets, s.prefixes)]))
    (a_sets, a_prefixes), (b_sets, b_prefixes) = numbered[0], numbered[-1]
    flat = np.concatenate(b_prefixes)
    starts = np.r_[0, np.cumsum([len(p) for p in b_prefixes])]
    for i, n in enumerate(a.n):
        low = max(int(np.searchsorted(b.n, -(-percent * n // 100))), i + 1 if same else 0)
        high = int(np.searchsorted(b.n, 100 * n // percent, side="right"))
        if low >= high:
            continue
        mark[a_prefixes[i]] = True
        common = np.add.reduceat(mark[flat[starts[low] : starts[high]]].astype(np.int64), starts[low:high] - starts[low])
        mark[a_prefixes[i]] = False
        near = low + np.flatnonzero(common >= fewest(np.minimum(n, b.n[low:high])))
        if not len(near):
            continue
        mark[a_sets[i]] = True
        shared = np.add.reduceat(mark[np.concatenate([b_sets[j] for j in near])].astype(np.int64), np.r_[0, np.cumsum(b.n[near])[:-1]])
        mark[a_sets[i]] = False
        found = near[shared * (100 + percent) >= percent * (n + b.n[near])]
        if len(found):
            yield i, found


PAIRS, COUNTS = "low long, high long", "cls long, n_classes long, n_rows long"


def _compared_rows(make: Callable[[], SetOf], percent: int, fewest, as_pairs: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_of = make()
        held: dict[int, dict[int, tuple]] = {0: {}, 1: {}}
        last = None

        def compared() -> Iterator[pa.RecordBatch]:
            if not held[0] or (last[2] != last[3] or last[1]) and not held[1]:
                return
            a = Side(list(held[0].values()))
            b = Side(list(held[1].values())) if held[1] else a
            links = np.zeros((2, len(a.cls)), np.int64)
            back = links if b is a else np.zeros((2, len(b.cls)), np.int64)
            for i, partners in similar(a, b, percent, fewest):
                if as_pairs:
                    x, y = np.full(len(partners), a.cls[i]), b.cls[partners]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["low", "high"])
                links[:, i] += (len(partners), b.copies[partners].sum())
                back[0, partners] += 1
                back[1, partners] += a.copies[i]
            if not as_pairs:
                for side, counts in ((a, links), (b, back)) if b is not a else ((a, links),):
                    some = np.flatnonzero(counts[0])
                    yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (side.cls, *counts)], ["cls", "n_classes", "n_rows"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "up", "i", "j", "band", "side", "cls", "copies")]
            for data, row in zip(texts_of(batch), zip(*columns)):
                if row[:5] != last:
                    yield from compared()
                    held, last = {0: {}, 1: {}}, row[:5]
                side, cls, copies = row[5:]
                if cls not in held[side]:  # rows equal in id and text are one text
                    held[side][cls] = (cls, copies, *set_of(data))
        if last is not None:
            yield from compared()

    return rows


def compare_components(
    texts: DataFrame, members: DataFrame, make: Callable[[], SetOf], percent: int, fewest, as_pairs: bool, block: int = BLOCK
) -> DataFrame:
    """Similar pairs (low, high) of each component, or for each set the number of similar sets and of their rows.

    `texts` has doc, th, text; `members` has label, cls, n, copies and the doc and th of a text of each set. Tasks compare two blocks
    and add up, so apart from the pairs asked for no row of a pair leaves them.
    """
    placed = cut_lineage(blocks(members, percent, block))
    found = texts.where(may_hold(hash_filter(placed, "th"), "th")).join(placed, ["doc", "th"])
    dealt = (
        found.select("label", "cls", "copies", "text", F.explode("places").alias("p")).select("label", "p.*", "cls", "copies", "text")
        .repartition(*KEY).sortWithinPartitions(*KEY, "side", "cls")
    )
    out = dealt.mapInArrow(_compared_rows(make, percent, fewest, as_pairs), PAIRS if as_pairs else COUNTS)
    return out if as_pairs else out.groupBy("cls").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_rows").alias("n_rows"))
