"""Collocations: phrases that occur together far more often than their parts would, counted by suffix subtrees.

Every word of a piece of text starts a suffix, cut off after the longest phrase. All suffixes together form a tree whose node
totals are the counts of all phrases. The tree is built in parts that fit a memory budget (vertical partitioning): a word
is a prefix, a prefix with more occurrences than the budget is extended by a word, and prefixes are grouped until a group reaches
the budget. One pass over the texts sends each group its suffixes, counted before the shuffle, and a task builds the
subtree of a group at a time as sorted arrays and reads node totals off its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import list_array, mix, signed

#: Suffixes whose subtree a task holds. Beyond `MOST_GROUPS` groups they grow instead, so that tasks hold a table of 8 MB at most.
MEMORY, MOST_GROUPS = 1 << 20, 1 << 20
#: Suffixes and different words that a task counts together before it sends them off.
HELD, WORDS_HELD = 1 << 21, 1 << 18
#: Hash ranges within which running sums of prefixes are formed.
RANGES = 1024

#: What ends a piece, and what separates words within one.
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Capitals become small, whatever ends a piece a full stop (which no word holds), tabs spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"." * len(_ENDS) + b" ")
_STOP = b"."
_ODD = np.uint64(0x9E3779B97F4A7C15)

RUN = "grp int, lang string, words array<binary>, ids array<int>, counts array<long>"
NODES = "lang string, phrase string, depth int, n long"


def _codes(columns: list[np.ndarray], size: int) -> np.ndarray:
    """One number for each tuple of numbers below `size`, in the order of the tuples; ranked in between where it would not fit."""
    out, span = columns[0].astype(np.int64), size
    for column in columns[1:]:
        if span > 2**62 // size:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            span = int(out.max(initial=0)) + 1
        out, span = out * size + column, span * size
    return out


class Suffixes:
    """The truncated suffixes of the texts of one language, as word numbers; 0 is no word."""

    def __init__(self, depth: int):
        self.depth = depth
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {_STOP: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        words = data.translate(_PLAIN).replace(_STOP, b" . ").split(b" ")
        numbers = self.numbers
        out = np.empty(len(words) + 1, np.int32)
        k = 0
        for w in words:
            if w:
                n = numbers.get(w)
                if n is None:
                    n = numbers[w] = len(numbers)
                out[k] = n
                k += 1
        out[k] = 0
        self.parts.append(out[: k + 1])
        self.size += k + 1

    @property
    def full(self) -> bool:
        return self.size >= HELD or len(self.numbers) >= WORDS_HELD

    def leaves(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(different suffixes of up to `depth` words, how often): rows of word numbers."""
        ids = np.concatenate([*self.parts, np.zeros(depth, np.int32)])
        columns = [ids[: len(ids) - depth]]
        for d in range(1, depth):  # nothing follows the end of a piece
            columns.append(np.where(columns[-1] == 0, 0, ids[d : len(ids) - depth + d]))
        starts = np.flatnonzero(columns[0])
        columns = [c[starts] for c in columns]
        _, first, counts = np.unique(_codes(columns, len(self.numbers)), return_index=True, return_counts=True)
        return np.stack([c[first] for c in columns], axis=1) if len(first) else np.zeros((0, depth), np.int32), counts.astype(np.int64)


def _prefix_keys(rows: np.ndarray, hashes: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """64-bit keys of the prefixes of 1, 2, .. words of suffixes."""
    key = np.full(len(rows), seed, np.uint64)
    for d in range(rows.shape[1]):
        key = mix((key * _ODD) ^ hashes[rows[:, d]])
        yield key


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


def _by_language(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[str, Suffixes]]:
    """The suffixes of each language, whenever enough of them are held and at the end."""
    held: dict[str, Suffixes] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, text in zip(langs, batch.column("text").cast(pa.binary())):
            own = held.setdefault(lang, Suffixes(depth))
            data = text.as_py()
            for at in _stretches(data):
                own.add(data[at])
                if own.full:
                    yield lang, own
                    own.clear()
        while sum(s.size for s in held.values()) >= HELD:  # many languages
            lang = max(held, key=lambda k: held[k].size)
            yield lang, held.pop(lang)
    yield from held.items()


def _stretches(data: bytes, step: int = 1 << 22) -> Iterator[slice]:
    """Slices of about `step` bytes that end where a piece ends; a longer piece stays whole."""
    start = 0
    while len(data) - start > step:
        ends = [e for e in (data.find(bytes([c]), start + step) for c in _ENDS) if e >= 0]
        if not ends:
            break
        yield slice(start, min(ends) + 1)
        start = min(ends) + 1
    yield slice(start, len(data))


def _prefix_rows(depth: int, heavy: list):
    """(key, n) of the prefixes of `depth` words whose shorter prefixes are all over the budget."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_language(batches, depth):
            leaves, counts = own.leaves(depth)
            hashes = _word_hashes(list(own.numbers))
            wanted = np.ones(len(leaves), bool)
            for d, key in enumerate(_prefix_keys(leaves, hashes, xxhash.xxh3_64_intdigest(lang.encode()))):
                if d < depth - 1:
                    wanted &= _in(heavy[d].value, key)
            keys, counts = key[wanted], counts[wanted]
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], ["key", "n"])

    return rows


def _run_rows(depth: int, heavy: list, bounds):
    """The counted suffixes of a task, for each language and group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_language(batches, depth):
            leaves, counts = own.leaves(depth)
            if not len(leaves):
                continue
            words = list(own.numbers)
            group = np.full(len(leaves), -1, np.int32)
            for d, key in enumerate(_prefix_keys(leaves, _word_hashes(words), xxhash.xxh3_64_intdigest(lang.encode()))):
                ends = (group < 0) & (True if d == depth - 1 else ~_in(heavy[d].value, key))
                group[ends] = np.searchsorted(bounds.value, key[ends], side="right")
            order = np.argsort(group, kind="stable")
            leaves, counts, group = leaves[order], counts[order], group[order]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for a, b in zip(first, [*first[1:], len(group)]):
                used, ids = np.unique(leaves[a:b], return_inverse=True)
                if used[0] != 0:
                    used, ids = np.r_[0, used], ids + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[a]], pa.int32()), pa.array([lang]),
                        list_array([len(used)], pa.array([words[u] for u in used], pa.binary())),
                        list_array([ids.size], pa.array(ids.ravel().astype(np.int32))),
                        list_array([b - a], pa.array(counts[a:b])),
                    ],
                    [f.split()[0] for f in RUN.split(", ")],
                )

    return rows


class Subtree:
    """Suffixes of one language and group; nodes are ranges of the sorted suffixes."""

    def __init__(self, lang: str, depth: int):
        self.lang, self.depth = lang, depth
        self.numbers: dict[bytes, int] = {_STOP: 0}
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.loose = 0

    def add(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        turn = np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in words), np.int32, len(words))
        self.rows.append(turn[ids.reshape(-1, self.depth)])
        self.counts.append(counts)
        self.loose += len(counts)
        if self.loose > MEMORY:
            self._merge()

    def _merge(self) -> None:
        """Add up equal suffixes and sort."""
        rows, counts = np.concatenate(self.rows), np.concatenate(self.counts)
        codes = _codes(list(rows.T), len(self.numbers))
        order = np.argsort(codes, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
        self.rows, self.counts = [rows[order[first]]], [np.add.reduceat(counts[order], first)]
        self.loose = 0

    def nodes(self, least: int, keep) -> Iterator[tuple[list[str], int, np.ndarray]]:
        """(phrases, depth, totals) of nodes with at least `least` occurrences, or that `keep` names, and the total of all."""
        self._merge()
        rows, counts, words = self.rows[0], self.counts[0], list(self.numbers)
        yield [""], 0, counts.sum(keepdims=True)
        hashes = _word_hashes(words)
        changed = np.zeros(len(rows), bool)
        changed[:1] = True
        keys = _prefix_keys(rows, hashes, xxhash.xxh3_64_intdigest(self.lang.encode()))
        for d, key in enumerate(keys):
            changed[1:] |= rows[1:, d] != rows[:-1, d]
            first = np.flatnonzero(changed)
            totals = np.add.reduceat(counts, first)
            kept = (rows[first, d] > 0) & ((totals >= least) | keep(d, key[first]))
            phrases = [b" ".join([words[i] for i in row]).decode() for row in rows[first[kept], : d + 1]]
            yield phrases, d + 1, totals[kept]


def _node_rows(depth: int, least: int, heavy: list):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def over(d: int, keys: np.ndarray) -> np.ndarray:
            """A prefix over the budget is spread over groups, and its parts are added up afterwards."""
            return _in(heavy[d].value, keys) if d < len(heavy) else np.zeros(len(keys), bool)

        def finished(tree: Subtree) -> Iterator[pa.RecordBatch]:
            for phrases, d, totals in tree.nodes(least, over):
                for at in range(0, len(phrases), 10_000):
                    own = phrases[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree.lang] * len(own)), pa.array(own, pa.string()), pa.array([d] * len(own), pa.int32()), pa.array(totals[at : at + 10_000])],
                        [f.split()[0] for f in NODES.split(", ")],
                    )

        last, tree = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at = (batch.column("grp")[i].as_py(), batch.column("lang")[i].as_py())
                if at != last:
                    if tree is not None:
                        yield from finished(tree)
                    last, tree = at, Subtree(at[1], depth)
                tree.add(
                    batch.column("words")[i].as_py(), batch.column("ids")[i].values.to_numpy(), batch.column("counts")[i].values.to_numpy()
                )
        if tree is not None:
            yield from finished(tree)

    return rows


def _group_bounds(prefixes: DataFrame, budget: int) -> np.ndarray:
    """Keys at which a new group starts: running sums of occurrences in key order, cut at multiples of the budget."""
    # unsigned order, as the tasks search in it
    placed = prefixes.withColumns({"place": F.col("key").bitwiseXOR(F.lit(-(2**63))), "part": F.shiftrightunsigned("key", 54)})
    sums = placed.groupBy("part").agg(F.sum("n").alias("total"))  # at most RANGES rows
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0))).drop("total")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.floor((F.col("before") + F.sum("n").over(inside) - F.col("n")) / budget)
    firsts = (
        placed.join(F.broadcast(starts), "part").withColumn("grp", group).groupBy("grp").agg(F.min("place").alias("place"))
    )
    keys = sorted(r["place"] + 2**63 for r in firsts.collect())  # at most MOST_GROUPS and one for each range
    return np.array(keys[1:], np.uint64)


def phrase_counts(
    df: DataFrame, longest: int = 3, least: int = 1, text_col: str = "text", lang_col: str = "lang", memory: int = MEMORY
) -> DataFrame:
    """(lang, phrase, depth, n): all phrases of up to `longest` words with at least `least` occurrences.

    Words are joined by a space; the row with depth 0 holds all word occurrences of a language. Occurrences are contiguous
    within a piece and may overlap. Texts are lower-cased (A-Z), cut into pieces at `.,;:!?`, line feed, vertical tab, form feed and
    carriage return, and pieces into words at spaces and tabs. A missing text has no words, a missing language is `und`.
    """
    texts = df.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    share = df.sparkSession.sparkContext.broadcast
    light, heavy, budget = None, [], memory
    for depth in range(1, longest + 1):
        prefixes = cut_lineage(
            texts.mapInArrow(_prefix_rows(depth, heavy), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        )
        if depth == 1:
            budget = max(memory, -(-(prefixes.agg(F.sum("n")).first()[0] or 0) // MOST_GROUPS))
        over = (F.col("n") > budget) if depth < longest else F.lit(False)
        fits = prefixes.where(~over)
        light = fits if light is None else light.union(fits)
        # each has more than the budget of all occurrences, so there are MOST_GROUPS at most
        large = [r["key"] % 2**64 for r in prefixes.where(over).select("key").collect()]
        if not large:
            break
        heavy.append(share(np.sort(np.array(large, np.uint64))))
    none = share(np.zeros(0, np.uint64))
    levels = [*heavy, *[none] * (longest - len(heavy))]
    bounds = share(_group_bounds(light, budget))
    runs = texts.mapInArrow(_run_rows(longest, levels, bounds), RUN)
    return (
        runs.repartition("grp")
        .sortWithinPartitions("grp", "lang")
        .mapInArrow(_node_rows(longest, least, levels), NODES)
        .groupBy("lang", "phrase", "depth")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least) | (F.col("depth") == 0))
    )


def _words(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(
    df: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    inside_percent: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    memory: int = MEMORY,
) -> DataFrame:
    """The `top` collocations of each language: lang, rank, phrase, a, l, r, n, score, cut.

    Candidates are phrases of 2 to `longest` words with at least `least` occurrences a. Cutting one after its first k words
    gives the counts l and r of both parts and the score floor(1000000 a² / (l r)); the lowest counts, of equal ones that with the smallest
    k. A candidate whose words stand within a longer one with at least `inside_percent` of its occurrences is part of
    that and left out. Ranked by score, then a, both falling, then phrase. n is the number of words of the language. Products
    are formed in 38 decimal digits, which is exact up to 10^15 occurrences.

    Edge cases are those of `phrase_counts`; an empty table gives an empty table. Other columns are not read.
    """
    counts = cut_lineage(phrase_counts(df, longest, least, text_col, lang_col, memory))
    nodes = counts.where("depth > 0").select("lang", "phrase", "depth", "n")
    wanted = nodes.where("depth > 1").select("lang", "phrase", "depth", F.col("n").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("depth") - 1))
    parts = wanted.withColumn("k", cut).withColumns(
        {"left": _words(F.col("phrase"), 1, F.col("k")), "right": _words(F.col("phrase"), F.col("k") + 1, F.col("depth") - F.col("k"))}
    )
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (
        parts.join(nodes.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(nodes.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .withColumns({"top": exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), "bottom": exact("l") * exact("r")})
        .withColumn("score", F.expr("top div bottom"))
        .groupBy("lang", "phrase", "depth", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    )
    # every shorter phrase of two words and more that stands within a candidate
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("depth") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("depth") - m + 1), lambda i: _words(F.col("phrase"), i, m)),
        )
    )
    longer = (
        wanted.where("depth > 2")
        .select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("outer"))
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    left = (
        scored.join(longer, ["lang", "phrase"], "left")
        .where(F.col("outer").isNull() | (100 * F.col("outer") < inside_percent * F.col("a")))
        .select("lang", "phrase", "a", "low.*")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    words = counts.where("depth = 0").select("lang", "n")  # one row for each language
    return (
        left.withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
        .join(words, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("cut"))
    )
