"""Long repeats across documents by winnowed anchors: what substring and suffix-array dedup share.

A window is `window` consecutive units (words or bytes) of one text. Every window selects one
anchor, the gram in it with the smallest hash, so equal windows select equal anchors at equal
offsets, and only texts that share an anchor can share a window. The consecutive windows that
select one anchor form a block. Blocks are compared in three steps, each on what the one before
left over: by anchor, as a whole, and window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import Rolling, WordHashes, list_array, order_id, signed, text_hash, texts_of

#: Odd, for polynomials modulo 2**64.
GRAM_BASE, BLOCK_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Positions that are looked at together; texts may be longer.
STRIDE = 1 << 19
#: Blocks of one anchor that one task compares; anchors with more are compared by shuffled windows.
TOGETHER = 512
#: Content, in bytes, that is compared at once in a task.
BATCH = 1 << 20

ANCHORS = "anchor long, block long, doc long, th long, first int, count int"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Anchors:
    """Selects anchors and hashes their blocks."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.grams, self.blocks = Rolling(GRAM_BASE), Rolling(BLOCK_BASE)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, block hash, first window, number of windows) for each block of a text."""
        parts = [self._stretch(x[at : at + STRIDE + self.window - 1], at) for at in range(0, max(1, len(x) - self.window + 1), STRIDE)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _stretch(self, x: np.ndarray, at: int):
        if len(x) < self.window:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        grams = self.grams.windows(x, self.gram)
        low = np.uint64(STRIDE * 2 - 1)
        # the place breaks ties, so the leftmost of equal grams is selected
        keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (_sliding_min(keys, self.window - self.gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        count = np.diff(np.r_[first, len(place)])
        prefix = self.blocks.prefix(x)
        block = self.blocks.between(prefix, first, first + count - 1 + self.window)
        lead = (place[first] - first).astype(np.uint64)
        return grams[place[first]], block + lead, first + at, count


def _bytes_to_numbers() -> Callable[[bytes], np.ndarray]:
    table = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64, endpoint=False)
    return lambda data: table[np.frombuffer(data, np.uint8)]


def _words_to_numbers() -> Callable[[bytes], np.ndarray]:
    hashes = WordHashes()
    return lambda data: hashes.of(data.split())


UNITS = {"words": _words_to_numbers, "bytes": _bytes_to_numbers}


def _anchor_rows(unit: str, window: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, anchors = UNITS[unit](), Anchors(window, gram)
        names = [f.split()[0] for f in ANCHORS.split(", ")]
        for batch in batches:
            found, sizes = [], []
            for data in texts_of(batch):
                found.append(anchors.of(numbers(data)))
                sizes.append(len(found[-1][0]))
            if not sum(sizes):
                continue
            anchor, block, first, count = (np.concatenate(p) for p in zip(*found))
            ids = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("doc", "th")]
            columns = [signed(anchor), signed(block), *ids, first.astype(np.int32), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows


def _content_rows(unit: str, window: int):
    """The content of the blocks named in `wanted`, cut out of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            for i, data in enumerate(texts_of(batch)):
                units = data.split() if unit == "words" else data
                out = {k: [] for k in ("anchor", "block", "part", "parts", "doc", "at", "again", "content")}
                for w in wanted[i].as_py():
                    piece = units[w["first"] : w["first"] + w["count"] - 1 + window]
                    for k in ("anchor", "block", "part", "parts", "again"):
                        out[k].append(w[k])
                    out["doc"].append(batch.column("doc")[i].as_py())
                    out["at"].append(w["first"])
                    out["content"].append(b" ".join(piece) if unit == "words" else piece)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(out[k], pa.int64()) for k in ("anchor", "block")],
                        *[pa.array(out[k], pa.int32()) for k in ("part", "parts")],
                        *[pa.array(out[k], pa.int64()) for k in ("doc", "at")],
                        pa.array(out["again"], pa.bool_()),
                        pa.array(out["content"], pa.binary()),
                    ],
                    list(out),
                )

    return rows


CONTENT = "anchor long, block long, part int, parts int, doc long, at long, again boolean, content binary"
VERDICTS = "open boolean, anchor long, block long, doc long, again boolean, lows array<int>, highs array<int>, windows array<long>"

#: (contents, order of each one, repeated anyhow) to the repeated windows: lists of offsets by content.
Settle = Callable[[list[bytes], np.ndarray, np.ndarray], list[np.ndarray]]


def _verdict_rows(unit: str, window: int, settle: Callable[[], Settle]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide, numbers, rolling = settle(), UNITS[unit](), Rolling(BLOCK_BASE)
        held: list[tuple] = []  # whole anchors
        size, last = 0, None

        def verdicts(rows: list[tuple], offsets: list[np.ndarray], hashes: list[np.ndarray], opened: bool):
            steps = [np.flatnonzero(np.diff(o, prepend=-2) != 1) for o in offsets]  # ranges of offsets
            lows = [o[k] for o, k in zip(offsets, steps)]
            highs = [np.r_[o[k[1:] - 1], o[-1:]] + 1 for o, k in zip(offsets, steps)]
            sizes = [len(k) for k in steps]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([opened] * len(rows), pa.bool_()),
                    *[pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)],
                    pa.array([r[4] for r in rows], pa.bool_()),
                    list_array(sizes, pa.array(np.concatenate(lows).astype(np.int32))),
                    list_array(sizes, pa.array(np.concatenate(highs).astype(np.int32))),
                    list_array([len(o) for o in hashes], pa.array(signed(np.concatenate(hashes)))),
                ],
                [f.split()[0] for f in VERDICTS.split(", ")],
            )

        def settled():
            order = np.array([(r[2], r[3]) for r in held], [("doc", np.int64), ("at", np.int64)])
            offsets = decide([r[5] for r in held], order, np.array([r[4] for r in held], bool))
            return verdicts(held, offsets, [np.zeros(0, np.uint64)] * len(held), False)

        for batch in batches:
            opened = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "block", "doc", "at", "again", "content", "parts"))):
                if row[6] > 1:
                    opened.append(row)
                    continue
                if size >= BATCH and row[0] != last:
                    yield settled()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[0]
            if opened:
                hashes = [rolling.windows(numbers(r[5]), window) for r in opened]
                yield verdicts(opened, [np.zeros(0, np.int64)] * len(opened), hashes, True)
        if held:
            yield settled()

    return rows


def repeated_spans(
    df: DataFrame,
    unit: str,
    window: int,
    gram: int,
    settle: Callable[[], Settle],
    earlier_only: bool,
    by_document: bool,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc, th, spans) for the texts with repeated windows; spans are the units covered by them.

    `earlier_only`: a window counts as repeated if an equal one comes earlier, else if there is any
    other. `by_document`: earlier means in a document with a smaller id, else also at a smaller place of the same
    document. `settle` builds the comparison of the blocks of whole anchors. `doc` is
    `order_id`, `th` is `text_hash`: rows equal in both have equal spans.
    """
    texts = df.select(order_id(id_col).alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    anchors = texts.mapInArrow(_anchor_rows(unit, window, gram), ANCHORS)
    # 1. anchors that occur once are dropped; the counts are formed before the shuffle
    # written, so the join has shuffles of its own and a frequent anchor can be split among tasks
    shared = cut_lineage(
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("block").alias("a"), F.max("block").alias("b"))
        .where("low < high" if by_document else "n > 1")
        .select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    )
    hits = cut_lineage(anchors.join(shared, "anchor"))
    # 2. equal blocks repeat all of their windows
    place = F.struct("doc", "th", "first", "count")
    blocks = cut_lineage(
        hits.groupBy("anchor", "block").agg(F.min(place).alias("rep"), F.count("*").alias("n"), F.first("mixed").alias("mixed"))
    )
    # 3. different blocks of one anchor share some windows or none
    many = blocks.where("mixed").groupBy("anchor").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    wanted = (
        blocks.where("mixed")
        .join(many, "anchor")
        .select(
            "rep.doc", "rep.th",
            F.struct(
                "anchor", "block", F.pmod("block", "parts").cast("int").alias("part"), "parts",
                (F.lit(not earlier_only) & (F.col("n") > 1)).alias("again"), "rep.first", "rep.count",
            ).alias("w"),
        )
        .groupBy("doc", "th")
        .agg(F.collect_list("w").alias("wanted"))
    )
    # rows equal in doc and th are equal texts, one of them is enough
    content = (
        texts.join(wanted, ["doc", "th"])
        .mapInArrow(_content_rows(unit, window), CONTENT)
        .repartition("anchor", "part")
        .sortWithinPartitions("anchor", "block", "doc", "at")
    )
    verdicts = cut_lineage(content.mapInArrow(_verdict_rows(unit, window, settle), VERDICTS))
    closed = verdicts.where("not open").select("anchor", "block", F.explode(F.arrays_zip("lows", "highs")).alias("z")).select("anchor", "block", "z.lows", "z.highs")
    opened = verdicts.where("open").select("anchor", "block", "doc", "again", F.posexplode("windows").alias("offset", "value"))
    mine = F.struct("doc", "block", "offset") if not by_document else F.col("doc")
    totals = cut_lineage(
        opened.groupBy("anchor", "value").agg(F.min(mine).alias("low"), F.count("*").alias("n"), F.max("again").alias("any"))
    )
    repeated = (mine > F.col("low")) if earlier_only else ((F.col("n") > 1) | F.col("any"))
    late = opened.join(totals, ["anchor", "value"]).where(repeated).select("anchor", "block", "offset", F.col("offset") + 1)
    some = closed.union(late).groupBy("anchor", "block").agg(F.collect_set(F.struct("lows", "highs")).alias("ranges"))

    ahead = F.struct("doc") > F.struct("rep.doc") if by_document else place > F.col("rep")
    whole = ahead if earlier_only else F.col("n") > 1
    spans = (
        hits.drop("mixed")
        .join(blocks.select("anchor", "block", "rep", "n"), ["anchor", "block"])
        .join(some, ["anchor", "block"], "left")
        .withColumn("whole", whole)
        .where("whole or ranges is not null")
        .select(
            "doc", "th",
            F.explode(
                F.when(F.col("whole"), F.array(F.struct(F.col("first").alias("start"), (F.col("first") + F.col("count") - 1 + window).alias("end"))))
                .otherwise(F.transform("ranges", lambda r: F.struct((F.col("first") + r.lows).alias("start"), (F.col("first") + r.highs - 1 + window).alias("end"))))
            ).alias("span"),
        )
    )
    # spans that touch or overlap are one repeat
    order = Window.partitionBy("doc", "th").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.select("doc", "th", "span.start", "span.end")
        .distinct()
        .withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("doc", "th", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("doc", "th")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )


def cut_rows(unit: str, extra: list[str]):
    """Kept content and counts of each text; spans are what to remove."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, n, removed, runs = batch.column("spans"), [], [], [], []
            for i, data in enumerate(texts_of(batch, "__text")):
                units = data.split() if unit == "words" else data
                parts, at, gone = [], 0, spans[i].as_py() or []
                for s in gone:
                    parts.append(units[at : s["start"]])
                    at = s["end"]
                parts.append(units[at:])
                kept.append(b" ".join(w for p in parts for w in p) if unit == "words" else b"".join(parts))
                n.append(len(units))
                removed.append(sum(s["end"] - s["start"] for s in gone))
                runs.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in extra],
                    *[pa.array(v, pa.int64()) for v in (n, removed, runs)],
                    spans,
                    pa.array(kept, pa.binary()),
                ],
                [*extra, "n_units", "n_removed", "n_spans", "spans", "kept"],
            )

    return rows


def cut_repeats(df: DataFrame, spans: DataFrame, unit: str, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of `df`: id, n_units, n_removed, n_spans, spans, kept (UTF-8)."""
    return (
        df.select(F.col(id_col).alias("__id"), order_id(id_col).alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("__text"))
        .join(spans, ["doc", "th"], "left")
        .select("__id", "spans", "__text")
        .mapInArrow(
            cut_rows(unit, ["__id"]),
            f"__id {dict(df.dtypes)[id_col]}, n_units long, n_removed long, n_spans long, "
            "spans array<struct<start:int,end:int>>, kept binary",
        )
        .withColumnRenamed("__id", id_col)
    )
