"""Order MinHash fingerprints of texts. DataFrame functions only: no Python runs on executors.

A text is the sequence of its k-mers (windows of bytes), each numbered by how often it came before, so
that repeats are told apart. All of them are hashed to a circle. Of each of `samples` marks on the circle the next
`tuple_size` k-mers are selected, put back into the order they have in the text, and hashed as a tuple. Two
texts agree at a mark if they select the same k-mers there in the same order, which edits and moved passages spoil:
the share of equal marks is sensitive to edit distance, not only to the set of k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import order_id, text_hash

#: An entry is 33 bits of hash (signed) over 31 bits of position; no text of Spark has more bytes.
PLACE_BITS = 31
LOW = 2**PLACE_BITS - 1
#: Close entries that a mark of a long text can expect.
SEEN = 12
#: Documents in a bucket; the number of buckets grows with the table, up to this many borders, and buckets grow beyond.
PER_BUCKET, BORDERS = 1 << 11, 1 << 16
#: Borders that are compared one by one.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _indexes(n: Column) -> Column:
    """0 to n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def _place_of(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit(LOW))


def _entry(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed, PLACE_BITS).bitwiseOR(place)


def _same_kmer(a: Column, b: Column) -> Column:
    return F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0


def _entries(data: Column, k: int) -> Column:
    """An entry for each k-mer of a binary, positions from 1. A binary of fewer than k bytes is one k-mer."""
    places = F.sequence(F.lit(1), F.greatest(F.length(data) - (k - 1), F.lit(1)))
    return F.transform(places, lambda p: _entry(F.xxhash64(F.substring(data, p, F.lit(k))), p.cast("long")))


def _numbered(s: Column, behind: Column) -> Column:
    """Sorted entries with occurrence numbers: second and later occurrences of a k-mer get a mark of their own.

    In order the occurrences of a k-mer stand together, in text order, and the place in such a run is the number. The hash of
    k-mer and number chooses the mark; the distance from it stays that of the k-mer.
    """

    def late(before: Column) -> Column:
        return F.filter(s, lambda x, i: _same_kmer(x, _at(before, i)))

    def runs(r: Column) -> Column:
        starts = F.filter(_indexes(F.size(r)), lambda u: (u == 0) | ~_same_kmer(_at(r, u), _at(r, u - 1)))

        def renewed(first: Column, end: Column) -> Column:
            turn = lambda x, o: F.xxhash64(F.shiftright(x, PLACE_BITS), o).bitwiseAND(F.bitwise_not(behind)).bitwiseOR(x.bitwiseAND(behind))
            return F.transform(F.sequence(first, end - 1), lambda u: _let(_at(r, u), lambda x: turn(x, u - first + 1)))

        ends = lambda g: F.concat(F.slice(g, 2, F.size(g)), F.array(F.size(r)))
        return F.when(F.size(r) == 0, s).otherwise(
            F.concat(F.array_except(s, r), _let(starts, lambda g: F.flatten(F.zip_with(g, ends(g), renewed))))
        )

    # each entry's neighbour; the first gets one with another hash
    before = F.concat(F.array(F.bitwise_not(_at(s, F.lit(0)))), F.slice(s, 1, F.size(s) - 1))
    return F.when(F.size(s) < 2, s).otherwise(_let(before, lambda b: _let(late(b), runs)))


def order_minhash(text: Column, k: int = 8, tuple_size: int = 2, samples: int = 64) -> Column:
    """The fingerprint of a text: eight hexadecimal digits for each of `samples` marks; empty for a missing or empty text.

    K-mers are windows of k bytes of UTF-8. `samples` is a power of two. Marks divide the circle evenly, so with many k-mers
    each mark selects from a part of its own, a random sample of all k-mers; with few the marks share them. Equal texts have
    equal fingerprints. A text of fewer than `tuple_size` k-mers selects all that it has, some of them twice.

    Whether a k-mer is close behind a mark does not depend on its number, so in a long text only close ones are numbered and
    sorted; if any mark has too few of them, all k-mers are.
    """
    step = 2 ** (64 - PLACE_BITS) // samples
    marks = F.array(*[F.lit((j * step - 2 ** (63 - PLACE_BITS)) << PLACE_BITS).cast("long") for j in range(samples)])
    behind = F.lit((step << PLACE_BITS) - 1)  # bits of an entry's distance from the mark before it

    def tuple_hash(members: list[Column]) -> Column:
        # positions first, so the members are sorted into text order; a negative number has sixteen digits
        turned = F.array(*[F.shiftleft(x, 64 - PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, PLACE_BITS)) for x in members])
        hashes = F.transform(F.sort_array(turned), lambda x: x.bitwiseAND(F.lit(LOW)))
        return F.substring(F.hex(F.xxhash64(hashes).bitwiseOR(F.lit(-(2**63)))), 9, 8)

    def selected(ordered: Column, found: Column) -> Column:
        """Before mark j, at found[j], stand j marks and as many entries as its rank among them."""
        chosen = lambda own: F.transform(
            found, lambda i, j: tuple_hash([_at(own, F.pmod(i - j + r, F.size(own))) for r in range(tuple_size)])
        )
        return _let(F.array_except(ordered, marks), chosen)

    def marked(entries: Column, body: Callable[[Column, Column], Column]) -> Column:
        """body(entries and marks in order, where the marks are)."""
        at_marks = lambda e: F.filter(_indexes(F.size(e)), lambda i: _place_of(_at(e, i)) == 0)
        numbered = lambda s: F.sort_array(F.concat(_numbered(s, behind), marks))
        return _let(_let(F.sort_array(entries), numbered), lambda e: _let(at_marks(e), lambda found: body(e, found)))

    def fingerprint(entries: Column) -> Column:
        most = F.floor(F.lit(step * SEEN * samples) / F.size(entries)).cast("long") * F.lit(2**PLACE_BITS)
        few = F.size(entries) <= SEEN * samples

        def close_or_all(ordered: Column, found: Column) -> Column:
            ends = F.concat(F.slice(found, 2, samples), F.array(F.size(ordered)))
            short = F.exists(F.zip_with(found, ends, lambda a, b: b - a <= tuple_size), lambda lacks: lacks)
            return F.when(~few & short, marked(entries, selected)).otherwise(selected(ordered, found))

        close = F.when(few, entries).otherwise(_let(most, lambda m: F.filter(entries, lambda x: x.bitwiseAND(behind) < m)))
        return F.array_join(marked(close, close_or_all), "")

    plain = F.coalesce(text, F.lit("")).cast("binary")
    return F.when(F.length(plain) == 0, F.lit("")).otherwise(_let(plain, lambda data: _let(_entries(data, k), fingerprint)))


def likeness(a: Column, b: Column) -> Column:
    """Share of marks at which two fingerprints agree; 1 for two empty texts, 0 for an empty and another one."""
    parts = lambda f: F.regexp_extract_all(f, F.lit("[0-9A-F]{8}"), F.lit(0))
    equal = F.size(F.filter(F.zip_with(parts(a), parts(b), lambda x, y: x == y), lambda same: same))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(equal / (F.length(a) / 8))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """(id, n_chars, fingerprint) for each row of `df`; a missing text is empty, other columns are not read."""
    return df.select(
        id_col, F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        order_minhash(F.col(text_col), **shape).alias("fingerprint"),
    )


def _cuts(df: DataFrame, order: str, per_bucket: int) -> list[int]:
    """Values of a long column that cut the table into buckets of about `per_bucket` rows; at most `BORDERS`, with repeats.

    Only the size of buckets depends on these quantiles, which are approximate; the result does not.
    """
    rows = df.agg(F.count("*")).first()[0]
    cuts = min(BORDERS, rows // per_bucket)
    if not cuts:
        return []
    return sorted(int(b) for b in df.stat.approxQuantile(order, [(i + 1) / (cuts + 1) for i in range(cuts)], 0.5 / (cuts + 1)))


def _count_below(cuts: list[int], value: Column, strictly: bool) -> Column:
    """How many sorted cuts are below (or at) a value: among every `BLOCK`-th cut first, then within one block."""
    numbers = lambda v: F.split(F.lit(",".join(map(str, v))), ",").cast("array<bigint>")  # noqa: E731  one literal
    below = (lambda c: c < value) if strictly else (lambda c: c <= value)
    block = F.size(F.filter(numbers(cuts[::BLOCK]), below))
    start = F.greatest(block - 1, F.lit(0)) * BLOCK
    return start + F.size(F.filter(F.slice(numbers(cuts), start + 1, F.lit(BLOCK)), below))


def with_next(df: DataFrame, at: str, tie: str, last: str, derived: dict[str, Column], ahead: list[str], per_bucket: int = PER_BUCKET) -> DataFrame:
    """`df` with `derived` columns, and `next_<column>` of the row that follows in the order of (at, tie, last).

    `at` and `tie` are longs without NULL; the first row follows the last one. Rows are dealt into buckets of neighbours,
    and the first row of a bucket is added to the bucket before, so the table is shuffled once. A value of `at` that
    fills several buckets is split among them by `tie`.
    """
    cuts = _cuts(df.select(at), at, per_bucket)
    bucket = F.lit(0)
    if cuts:
        low, high = _count_below(cuts, F.col(at), True), _count_below(cuts, F.col(at), False)
        share = F.col(tie).cast("double") / 2.0**64 + 0.5
        bucket = low + F.least(F.floor(share * (high - low + 1)), high - low)
    placed = df.withColumns({"__bucket": bucket.cast("int"), "__extra": F.lit(0)})
    # one small row for each bucket
    first = cut_lineage(placed.groupBy("__bucket").agg(F.min(F.struct(at, tie)).alias("f")).select("__bucket", f"f.{at}", f"f.{tie}"))
    buckets = Window.orderBy("__bucket")
    whole = buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = first.withColumn("__to", F.coalesce(F.lag("__bucket").over(buckets), F.last("__bucket").over(whole)))
    heads = Window.partitionBy("__bucket").orderBy(last)
    carried = (
        placed.join(before, ["__bucket", at, tie])
        .withColumn("__n", F.row_number().over(heads))
        .where("__n = 1")
        .withColumns({"__bucket": F.col("__to"), "__extra": F.lit(1)})
        .select(placed.columns)
    )
    inside = Window.partitionBy("__bucket").orderBy("__extra", at, tie, last)
    return (
        placed.withColumns(derived)
        .union(carried.withColumns(derived))
        .withColumns({f"next_{c}": F.lead(c).over(inside) for c in ahead})
        .where("__extra = 0")
        .drop("__bucket", "__extra")
    )


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **shape) -> DataFrame:
    """Each text's fingerprint beside that of an edited text, and how alike they and the next document's are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    in id order; after the last comes the first. Rows of equal id are ordered by a hash of their text, a missing id comes last, a
    missing text is empty; a single document follows itself. Columns: id, n_chars, edited_text, fingerprint,
    edited_fingerprint, near_edited, near_next. Other columns are not read; an empty table gives an empty table.
    """
    own = df.select(
        F.col(id_col).alias("id"), order_id(id_col).alias("at"), text_hash(text_col).alias("tie"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    mark = {"fingerprint": order_minhash(F.col("text"), **shape)}
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return (
        with_next(own, "at", "tie", "text", mark, ["text", "fingerprint"])
        .withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
        .withColumn("edited_fingerprint", order_minhash(F.col("edited_text"), **shape))
        .select(
            F.col("id").alias(id_col), n.cast("long").alias("n_chars"), "edited_text", "fingerprint", "edited_fingerprint",
            likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
            likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        )
    )
