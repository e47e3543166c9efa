"""N-gram Jaccard join: documents whose sets of word shingles are similar, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import connected_components
from .filters import hash_filter, may_hold
from .similar_pairs import BLOCK, compare_components
from .tokens import LOWER, Rolling, WordHashes, list_array, order_id, signed, text_hash, texts_of

#: The table of shingle frequencies has this many bits of places: 4 MB in a task, whatever the input.
TABLE_BITS = 20
CHUNK = 4096


class Shingles:
    """Distinct shingles of a text, as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.n, self.words, self.rolling = words, WordHashes(limit=100_000), Rolling(0xD1342543DE82EF95)

    def all(self, text: bytes) -> np.ndarray:
        x = self.words.of(text.translate(LOWER).split())
        return self.rolling.windows(x, min(self.n, len(x))) if len(x) else np.zeros(0, np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        return np.unique(self.all(text))


def _places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _frequency_rows(shingle: int):
    """Sums of a task: how many shingles of its texts fall on each place of the table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, table = Shingles(shingle), np.zeros(2**TABLE_BITS, np.int64)
        for batch in batches:
            for data in texts_of(batch):
                np.add.at(table, _places(shingles.of(data)), 1)
        chunks = [k for k in range(2**TABLE_BITS // CHUNK) if table[k * CHUNK : (k + 1) * CHUNK].any()]
        if chunks:
            values = np.concatenate([table[k * CHUNK : (k + 1) * CHUNK] for k in chunks])
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int32()), list_array([CHUNK] * len(chunks), pa.array(values))], ["chunk", "counts"]
            )

    return rows


def _sum_chunks(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CHUNK, np.int64)
    for part in parts:
        for counts in part.column("counts"):
            total += counts.values.to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), list_array([CHUNK], pa.array(total))], ["chunk", "counts"])


def shingle_frequencies(texts: DataFrame, shingle: int) -> np.ndarray:
    """Frequencies of hash places over all texts; 2**TABLE_BITS numbers."""
    rows = texts.select("text").mapInArrow(_frequency_rows(shingle), "chunk int, counts array<bigint>")
    # a task's sums of 4,096 places in one row; chunks meet by their number
    table = np.zeros(2**TABLE_BITS, np.int64)
    for row in rows.groupBy("chunk").applyInArrow(_sum_chunks, "chunk int, counts array<bigint>").toLocalIterator():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = row["counts"]
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def common_grams(n: int) -> int:
    """Shingles that the prefixes of similar sets share at least; one for small sets."""
    return 1 + min(3, n // 50)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n, in any order, of which a similar set holds `common_grams`."""
    return min(n, n - -(-percent * n // 100) + common_grams(n))


#: Bits of a set's bitmap, 64 in each number.
BITMAP = 256
BITS = [f"bits{k}" for k in range(BITMAP // 64)]


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each place of the bitmap: whether an odd number of shingles falls on it."""
    odd = np.bincount((h >> np.uint64(20)).astype(np.int64) & (BITMAP - 1), minlength=BITMAP).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


SETS = "doc long, th long, n int, sig long, sig2 long, prefix array<bigint>, " + ", ".join(f"{b} long" for b in BITS)


def _set_rows(shingle: int, percent: int, table):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, frequency = Shingles(shingle), table.value
        ones, twos = (np.random.default_rng(k).integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1) for k in (1, 2))
        for batch in batches:
            n, sizes, prefixes, signatures, bits = [], [], [], ([], []), []
            for data in texts_of(batch):
                own = shingles.of(data)
                rare = own[np.argsort(frequency[_places(own)], kind="stable")]  # rare first, then by hash
                n.append(len(own))
                k = prefix_length(len(own), percent) if len(own) else 0
                sizes.append(k)
                prefixes.append(rare[:k])
                bits.append(bitmap(own))
                for out, (a, b) in zip(signatures, (ones, twos)):
                    x = own * a
                    out.append(int(((x ^ (x >> np.uint64(29))) * b).sum(dtype=np.uint64)))
            bits = np.array(bits, np.int64).reshape(-1, len(BITS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), batch.column("th"), pa.array(n, pa.int32()),
                    *[pa.array(signed(np.array(s, np.uint64))) for s in signatures],
                    list_array(sizes, pa.array(signed(np.concatenate(prefixes)))),
                    *[pa.array(bits[:, k]) for k in range(len(BITS))],
                ],
                [f.split()[0] for f in SETS.split(", ")],
            )

    return rows


def suffix_filter(a: np.ndarray, b: np.ndarray, missing: int, depth: int = 3) -> bool:
    """Whether two sorted sets may differ in at most `missing` shingles: False is certain.

    The middle shingle of a splits both sets; shingles on different sides are different, so the
    sizes of the sides bound the difference, and each side is split again.
    """

    def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if not depth or not len(a) or not len(b):
            return abs(len(a) - len(b))
        m = len(a) // 2
        at = int(np.searchsorted(b, a[m]))
        hit = at < len(b) and b[at] == a[m]
        return bound(a[:m], b[:at], depth - 1) + (not hit) + bound(a[m + 1 :], b[at + hit :], depth - 1)

    return bound(a, b, depth) <= missing


def _verified_rows(shingle: int, percent: int):
    """Pairs whose sets are similar; the sets are formed from the texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(shingle)
        sets: dict[str, tuple] = {"low": (None, None), "high": (None, None)}  # rows come sorted by one of them
        for batch in batches:
            ids = {side: batch.column(side).to_numpy() for side in sets}
            texts, found = {side: batch.column(f"{side}_text").cast(pa.binary()) for side in sets}, []
            for i in range(batch.num_rows):
                for side, (last, _) in sets.items():
                    if ids[side][i] != last:
                        sets[side] = (ids[side][i], shingles.of(texts[side][i].as_py() or b""))
                a, b = sets["low"][1], sets["high"][1]
                # with i shared of |a| + |b| - i: i >= percent (|a| + |b|) / (100 + percent)
                both = len(a) + len(b)
                least = -(-percent * both // (100 + percent))
                found.append(
                    suffix_filter(a, b, both - 2 * least) and len(np.intersect1d(a, b, assume_unique=True)) >= least
                )
            keep = np.flatnonzero(np.array(found, bool))
            yield pa.RecordBatch.from_arrays([pa.array(ids["low"][keep]), pa.array(ids["high"][keep])], ["low", "high"])

    return rows


def _set_and_prefix(shingle: int, percent: int, table):
    def make():
        shingles, frequency = Shingles(shingle), table.value

        def of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            own = shingles.of(text)
            return own, own[np.argsort(frequency[_places(own)], kind="stable")][: prefix_length(len(own), percent)]

        return of

    return make


def _fewest(n: np.ndarray) -> np.ndarray:
    return 1 + np.minimum(3, n // 50)  # common_grams


@dataclass
class Joined:
    """Texts (doc, th, text), sets of rows, classes of equal sets and the component (`label`) of each class."""

    texts: DataFrame
    sets: DataFrame
    classes: DataFrame
    labels: DataFrame
    alone: Column
    compared: dict

    def links(self, as_pairs: bool, block: int = BLOCK) -> DataFrame:
        """Links between classes: pairs (low, high), or counts by class."""
        members = self.classes.where("n > 0").select("cls", "doc", "th", "n", "copies").join(self.labels, "cls")
        return compare_components(self.texts, members, as_pairs=as_pairs, block=block, **self.compared)

    def rows(self, counts: DataFrame | None = None) -> DataFrame:
        """(doc, th, n, class_doc, first, n_links) for each row: `first` is the (doc, th) that comes first in the component."""
        classes = self.classes.join(self.labels, "cls")
        if counts is None:
            classes = classes.withColumn("n_rows", F.lit(None).cast("long"))
        else:
            classes = classes.join(counts.select("cls", "n_rows"), "cls", "left")
        # written, so the join below can split a component that holds many rows
        firsts = cut_lineage(classes.groupBy("label").agg(F.min(F.struct("doc", "th")).alias("first")))
        others = F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("n_rows", F.lit(0))).otherwise(0)
        named = cut_lineage(
            classes.join(firsts, "label").select(
                "n", "sig", "sig2", self.alone.alias("alone"), F.col("doc").alias("class_doc"), "first", others.alias("n_links")
            )
        )
        rows = self.sets.select("doc", "th", "n", "sig", "sig2", self.alone.alias("alone"))
        same = [rows[c].eqNullSafe(named[c]) for c in ("n", "sig", "sig2", "alone")]
        return rows.join(named, same[0] & same[1] & same[2] & same[3]).select(
            rows["doc"], rows["th"], rows["n"], "class_doc", "first", "n_links"
        )


def _joined(df: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, rounds: int) -> Joined:
    spark = df.sparkSession
    texts = df.select(order_id(id_col).alias("doc"), text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(shingle_frequencies(texts, shingle))
    # a written number is the same in every later read
    sets = cut_lineage(texts.mapInArrow(_set_rows(shingle, percent, table), SETS).withColumn("cls", F.monotonically_increasing_id()))
    # classes of equal sets, numbered like their first row; a document without shingles is a class of its own
    alone = F.when(F.col("n") == 0, F.struct("doc", "th"))
    classes = cut_lineage(
        sets.groupBy("n", "sig", "sig2", alone.alias("alone")).agg(F.min(F.struct("doc", "th", "cls")).alias("f"), F.count("*").alias("copies"))
        .select("f.cls", "n", "sig", "sig2", "f.doc", "f.th", "copies")
    )
    grams = F.lit(1) + F.least(F.lit(3), F.floor(F.col("n") / 50))  # common_grams
    postings = (
        sets.where("n > 0").select("cls", "n", "prefix").join(classes.select("cls"), "cls", "left_semi")
        .select("cls", "n", F.posexplode("prefix").alias("at", "gram"))
    )
    shared = cut_lineage(postings.groupBy("gram").agg(F.count("*").alias("many")).where("many > 1").select("gram"))
    # a class that shares too few shingles with all others together has no links
    postings = cut_lineage(postings.join(shared, "gram"))
    before = F.row_number().over(Window.partitionBy("cls").orderBy("at")) - 1
    linked = cut_lineage(
        postings.groupBy("cls").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= grams).select("cls")
    )
    linked = cut_lineage(sets.select("cls", *BITS).join(linked, "cls"))
    # shingles before this one that no other class has: `own`
    postings = cut_lineage(postings.join(linked, "cls").withColumn("own", F.col("at") - before))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (low, high). Of all texts only those pass on that a filter of the pairs' documents lets through."""
        wanted = cut_lineage(
            pairs.select(F.explode(F.array("low", "high")).alias("cls")).distinct().join(classes.select("cls", "doc", "th"), "cls")
        )
        found = texts.where(may_hold(hash_filter(wanted, "th"), "th"))
        # rows equal in id and text are one text
        whole = cut_lineage(found.join(wanted, ["doc", "th"]).groupBy("cls").agg(F.first("text").alias("text")))
        with_low = pairs.join(whole.toDF("low", "low_text"), "low")
        with_both = with_low.join(whole.toDF("high", "high_text"), "high")
        return cut_lineage(
            with_both.select("low", "high", "low_text", "high_text").mapInArrow(_verified_rows(shingle, percent), "low long, high long")
        )

    def candidates(lists: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs from the lists that pass the filters; `others` has the same columns under other names."""
        n, m, at, there = (F.col(c) for c in ("n", "m", "at", "there"))
        least = F.ceil(percent * (n + m) / (100 + percent))
        fewest = F.lit(1) + F.least(F.lit(3), F.floor(F.least(n, m) / 50))
        low = F.col("cls") < F.col("to")
        # the first `fewest` shared shingles stand within these prefixes, and what only one of the two has is bounded
        near = (at < n - least + fewest) & (there < m - least + fewest) & (F.col("own") <= n - least) & (F.col("alone") <= m - least)
        # sets that differ in few shingles have bitmaps that differ in few bits
        apart = sum(F.bit_count(F.col(b).bitwiseXOR(F.col(f"other_{b}"))) for b in BITS)
        return (
            lists.join(others, "gram")
            .where(
                (F.col("label") != F.col("that")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & near
                & (apart <= n + m - 2 * least)
            )
            # a pair may come from both ends, so its places are kept by end
            .groupBy(F.least("cls", "to").alias("low"), F.greatest("cls", "to").alias("high"))
            .agg(
                F.countDistinct("gram").alias("c"), F.first(least).alias("least"), F.first(fewest).alias("fewest"),
                F.max(F.when(low, at).otherwise(there)).alias("i"), F.first(F.when(low, n).otherwise(m)).alias("n"),
                F.max(F.when(low, there).otherwise(at)).alias("j"), F.first(F.when(low, m).otherwise(n)).alias("m"),
            )
            .where("c >= fewest and (i - c < n - least) and (j - c < m - least)")
            .select("low", "high")
        )

    labels = classes.select("cls", F.col("cls").alias("label"))
    links = spark.createDataFrame([], "low long, high long")
    other = [F.col(c).alias(a) for c, a in (("cls", "to"), ("n", "m"), ("at", "there"), ("own", "alone"), ("label", "that"), *((b, f"other_{b}") for b in BITS))]
    for k in range(rounds + 1):
        lists = postings.join(labels, "cls")
        # lists within one component have nothing to add
        mixed = cut_lineage(lists.groupBy("gram").agg(
            F.min("label").alias("a"), F.max("label").alias("b"),
            # a class with few shingles of its own is close to many others
            F.min_by(F.struct("cls", "n", "at", "own", "label", *BITS), F.struct(F.col("own") * int(k == 0), F.xxhash64(F.lit(k), "cls"))).alias("pivot"),
        ).where("a <> b"))
        if k < rounds:
            pairs = cut_lineage(candidates(lists, mixed.select("gram", "pivot.*").select("gram", *other)))
        else:
            open_lists = cut_lineage(lists.join(mixed.select("gram"), "gram"))
            pairs = cut_lineage(candidates(open_lists, open_lists.select("gram", *other)))
        if pairs.isEmpty():
            continue
        links = cut_lineage(links.union(verified(pairs)))
        labels = connected_components(links, classes.select("cls"))
    compared = {"make": _set_and_prefix(shingle, percent, table), "percent": percent, "fewest": _fewest}
    return Joined(texts, sets, classes, labels, alone, compared)


def _shown(column: str | Column, kind: str):
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value != 2**63 - 1, value).cast(kind)


def jaccard_join(
    df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1
) -> DataFrame:
    """Components of the documents linked by similar shingle sets: 100 * shared >= `percent` * united.

    Words are split at blanks, A-Z are lower-cased, a set holds the distinct runs of `shingle` words; a text with
    fewer words has one, a text without words none and no links. Documents with equal sets form one class, compared once.

    Sets are put in a global order, rare shingles first: by the frequency of the shingle's place in a table counted over all
    texts, then by hash. Similar sets share a shingle among their first ones (`prefix_length`), so postings of prefixes are
    joined. A pair is kept if the sizes allow it (length filter), if the shared shingles stand early enough for the
    pair's sizes and few enough others stand before them (positional filter, over all shared shingles of
    two prefixes, of which `common_grams` are needed). Pairs are made distinct; bitmaps of whole sets and the suffix
    filter, which splits both sets in halves, bound in how many shingles they differ, and what passes is
    verified once on the texts.

    Components are found first, for which few links of a group are enough. So `rounds` times each posting list
    proposes only pairs with one of its classes, first that with the fewest shingles of its own, which is close to
    most others; links join components. In the last round every remaining pair is proposed whose classes
    lie in different components, which makes the components exact: lists whose classes are all in one
    component propose nothing.

    Links are counted last: they lie within components, so the classes of each component are compared in blocks (`similar_pairs`), by
    sizes, prefixes and then whole sets, each pair once; tasks add up and no pairs are shuffled. `jaccard_links` returns the pairs.

    One row for each row of `df`: id, n_shingles, class_id (smallest id with an equal set), component_id
    (smallest id that links reach, itself included), n_links (other rows with a similar or equal set). A missing id counts as larger than any other and shows as missing; other
    columns are not read. Shingles are compared by 64-bit hashes.
    """
    kind = dict(df.dtypes)[id_col]
    joined = _joined(df, percent, shingle, id_col, text_col, rounds)
    return joined.rows(joined.links(as_pairs=False)).select(
        _shown("doc", kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        _shown("class_doc", kind).alias("class_id"), _shown("first.doc", kind).alias("component_id"), "n_links",
    )


def jaccard_links(
    df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1
) -> DataFrame:
    """(low_class, high_class): all links between classes of different sets, each once, by the ids that `jaccard_join` shows as class_id.

    Rows of one class are linked with each other and with the rows of linked classes. Classes of different sets that share their
    smallest id show it alike. A missing id counts as larger than any other.
    """
    kind = dict(df.dtypes)[id_col]
    joined = _joined(df, percent, shingle, id_col, text_col, rounds)
    name = joined.classes.select("cls", "doc")
    ends = joined.links(as_pairs=True).join(name.toDF("low", "a"), "low").join(name.toDF("high", "b"), "high")
    return ends.select(_shown(F.least("a", "b"), kind).alias("low_class"), _shown(F.greatest("a", "b"), kind).alias("high_class"))


def keep_one_of_each(df: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """The rows of `df` without near copies: of each component of `jaccard_join` the row with the smallest id.

    Texts without words are copies of nothing but of rows equal in id and text. Columns as in `df`.
    """
    kept = (
        _joined(df, percent, shingle, id_col, text_col, rounds)
        .rows()
        .where(F.struct("doc", "th") == F.col("first"))
        .select(F.col("doc").alias("__doc"), F.col("th").alias("__th"))
        .distinct()
    )
    return (
        df.withColumns({"__doc": order_id(id_col), "__th": text_hash(text_col)})
        .join(kept, ["__doc", "__th"])
        .groupBy("__doc", "__th")
        .agg(F.min_by(F.struct(*df.columns), F.xxhash64(*[c for c in df.columns if c != text_col])).alias("row"))
        .select("row.*")
    )
