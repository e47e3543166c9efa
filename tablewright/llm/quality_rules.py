"""Quality rules: counts per document and the frequency of lines across the documents of a host."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .filters import hash_filter, passes
from .tokens import Rolling, WordHashes, list_array, order_id, signed, texts_of

SYMBOLS = b"#*$%&|<>"
#: Words of a window whose repeats within a text are counted.
WINDOW = 8
#: Rows that a task looks at together, and words whose hashes it remembers: both bound its memory.
TOGETHER, REMEMBERED = 512, 100_000
_DIGITS = re.compile(rb"[0-9]+")
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")

FACTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<struct<hash:bigint,words:int>>"
)


def normal_line(line: bytes) -> bytes:
    """Lower case, digits as one 0, blanks as one space, no outer blanks."""
    return _DIGITS.sub(b"0", _BLANKS.sub(b" ", line).strip()).lower()


def repeated_words(hashes: np.ndarray, rolling: Rolling, window: int = WINDOW) -> int:
    """Words in windows that are found twice or more in the text."""
    values = rolling.windows(hashes, window)
    if len(values) < 2:
        return 0
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return int((np.cumsum(steps) > 0).sum())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def _fact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, rolling = WordHashes(limit=REMEMBERED), Rolling(0xD1342543DE82EF95)
    for batch in _slices(batches):
        facts, sizes, line_hashes, line_words = [], [], [], []
        for data in texts_of(batch):
            split = data.split()
            joined = b"".join(split)
            chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum())
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            seen, again, lines = set(), 0, {}
            for line in data.split(b"\n"):
                n = len(line.split())
                if n:
                    again += line in seen
                    seen.add(line)
                    lines.setdefault(xxhash.xxh3_64_intdigest(normal_line(line)), [0])[0] += n
            facts.append((len(split), chars, symbols, again, repeated_words(words.of(split), rolling)))
            sizes.append(len(lines))
            line_hashes.extend(lines)
            line_words.extend(n for (n,) in lines.values())
        lines = pa.StructArray.from_arrays(
            [pa.array(signed(np.array(line_hashes, np.uint64))), pa.array(line_words, pa.int32())], ["hash", "words"]
        )
        names = [f.split()[0] for f in FACTS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in batch.schema.names if c != "text"],
                *[pa.array([f[k] for f in facts], pa.int64()) for k in range(5)],
                list_array(sizes, lines),
            ],
            [*[c for c in batch.schema.names if c != "text"], *names],
        )


def row_key(id_col: str, host_col: str, text_col: str) -> Column:
    """128 bits that rows share only if they have one verdict: equal id, host and text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (id_col, host_col)]
    return F.md5(F.concat_ws("\x1f", *parts, F.coalesce(F.col(text_col), F.lit(""))))


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    min_words: int = 20,
    most_repeated: float = 0.3,
    most_documents: int = 10,
    most_of_host: float = 0.0,
    most_removed: float = 0.5,
    shared_documents: int | None = None,
) -> DataFrame:
    """One row for each row of `df`: its counts, the lines to remove and the verdict `kept`.

    Lines are normalised (case, digits, blanks) and hashed. For each host and line the documents
    with different texts that hold it are counted, so copies of a document count once; counts are
    formed before and after a shuffle by line and text. A line is above the limits if more than `most_documents`
    documents of the host and more than the share `most_of_host` of them hold it; without a share the count acts
    alike at every size of host. It is removed from all of
    them but the one with the smallest id. A document is depleted, and rejected, if more than the share `most_removed` of its
    words goes or fewer than `min_words` stay. `base_failed`: fewer than `min_words` words, or more than
    the share `most_repeated` in windows of eight words found twice in the text.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_lines, n_removed_words, removed (hashes of normalised lines) and key (`row_key`).
    With `shared_documents`, also what goes by that limit alone, whatever the size of the host: n_shared_lines, n_shared_words and the verdict
    kept_without_shared. It may be lower or higher than the other limits; both judge the lines as they came.
    A missing or empty text has no words and fails; a missing host is a host, a missing id counts as
    larger than any other. Rows with equal id, host and text share a verdict. Other columns are not read.
    """
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\x00"))
    facts = cut_lineage(
        df.select(
            F.col(id_col).alias("id"), order_id(id_col).alias("doc"), host.alias("host"), row_key(id_col, host_col, text_col).alias("key"),
            F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"),
        ).mapInArrow(_fact_rows, f"id {dict(df.dtypes)[id_col]}, doc long, host string, key string, digest string, {FACTS}")
    )
    lines = facts.select("host", "key", "doc", "digest", F.explode("lines").alias("line"))
    frequent = (
        lines.groupBy("host", F.col("line.hash").alias("hash"))
        .agg(F.countDistinct("digest").alias("n"), F.min("doc").alias("first"))
        .where(F.col("n") > (most_documents if shared_documents is None else min(most_documents, shared_documents)))
    )
    goes = F.col("n") > most_documents
    if most_of_host:
        hosts = facts.groupBy("host").agg(F.countDistinct("digest").alias("documents"))
        # a decimal share, as SQL compares it
        frequent = frequent.join(hosts, "host")
        goes = goes & (F.col("n") > F.lit(Decimal(str(most_of_host))) * F.col("documents"))
    shared = F.lit(False) if shared_documents is None else F.col("n") > shared_documents
    frequent = frequent.select("host", "hash", "first", goes.alias("goes"), shared.alias("shared")).where("goes or shared")
    removed = (
        lines.select("host", "key", "doc", "line.hash", "line.words")
        .distinct()
        .join(frequent, ["host", "hash"])
        .where(F.col("doc") > F.col("first"))
        .groupBy("key")
        .agg(
            F.sum(F.when(F.col("goes"), F.col("words"))).alias("n_removed_words"),
            F.collect_list(F.when(F.col("goes"), F.col("hash"))).alias("removed"),
            F.sum(F.when(F.col("shared"), F.col("words"))).alias("n_shared_words"),
            F.count_if("shared").cast("int").alias("n_shared_lines"),
        )
    )

    def depleted(gone: str) -> Column:
        left = F.col("n_words") - F.col(gone)
        return (F.col(gone) > 0) & ((F.col(gone) > most_removed * F.col("n_words")) | (left < min_words))

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * most_repeated * F.col("n_words"))
    judged = (
        facts.drop("lines", "digest", "host", "doc")
        .join(removed, "key", "left")
        .withColumns(
            {
                "n_removed_words": F.coalesce("n_removed_words", F.lit(0)),
                "removed": F.coalesce("removed", F.array().cast("array<bigint>")),
                "n_shared_words": F.coalesce("n_shared_words", F.lit(0)),
                "n_shared_lines": F.coalesce("n_shared_lines", F.lit(0)),
                "base_failed": failed,
            }
        )
        .withColumns({"kept": ~F.col("base_failed") & ~depleted("n_removed_words"), "n_removed_lines": F.size("removed")})
    )
    if shared_documents is None:
        judged = judged.drop("n_shared_words", "n_shared_lines")
    else:
        judged = judged.withColumn("kept_without_shared", ~F.col("base_failed") & ~depleted("n_shared_words"))
    return judged.withColumnRenamed("id", id_col)


def _cleaned_rows(columns: list[str], text_at: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            removed, out = batch.column("__removed"), []
            for i, text in enumerate(batch.column(text_at)):
                gone = {h % 2**64 for h in removed[i].as_py()}
                text = text.as_py()
                if gone and text:
                    lines = text.split("\n")
                    text = "\n".join(x for x in lines if xxhash.xxh3_64_intdigest(normal_line(x.encode())) not in gone)
                out.append(text)
            arrays = [batch.column(c) for c in columns]
            arrays[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows


def _rows_in(shared, inside: bool):
    """Rows whose `__hash` passes the filter, or those where it does not."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.full(batch.num_rows, not inside)
            mask[passes(shared.value, batch.column("__hash").to_numpy().view(np.uint64))] = inside
            yield batch.filter(pa.array(mask))

    return rows


def apply_quality_rules(
    df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits
) -> DataFrame:
    """The rows of `df` that `quality_rules` keeps, without the lines above its limits; columns as in `df`.

    Rows that are rejected or lose lines are known by their keys, and a filter of fixed size holds these. Rows that do not pass it stay as
    they are, without a shuffle; only the texts of the others are joined with their verdicts.
    """
    touched = cut_lineage(
        quality_rules(df, id_col, host_col, text_col, **limits)
        .where("not kept or n_removed_lines > 0")
        .groupBy("key")
        .agg(F.first("kept").alias("__kept"), F.first("removed").alias("__removed"))
        .withColumnRenamed("key", "__key")
    )
    shared = hash_filter(touched.select(F.xxhash64("__key").alias("h")), "h")
    schema = df.select(*[F.col(c) for c in df.columns]).schema
    keyed = df.withColumn("__key", row_key(id_col, host_col, text_col)).withColumn("__hash", F.xxhash64("__key"))
    same = keyed.mapInArrow(_rows_in(shared, False), keyed.schema).select(*df.columns)
    others = (
        keyed.mapInArrow(_rows_in(shared, True), keyed.schema)
        .join(touched, "__key", "left")
        .where("coalesce(__kept, true)")
        .withColumn("__removed", F.coalesce("__removed", F.array().cast("array<bigint>")))
        .drop("__key", "__hash", "__kept")
    )
    return same.union(others.mapInArrow(_cleaned_rows(df.columns, df.columns.index(text_col)), schema))
