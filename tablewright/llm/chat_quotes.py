"""Quotation linking: reply-ordered conversations without quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Marks of a quoted line: one > for each level, with blanks between them.
_MARKS = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
#: A line that announces a quote.
_ANNOUNCES = re.compile(r"^.{0,200}\b(wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
_PLAIN = re.compile(r"[\W_]+")
#: Missing turns come last.
LAST_TURN = 2**63 - 1
#: Turns of a conversation that one window looks at.
SPAN = 1024


def normal_passage(text: str) -> str:
    """Words in lower case with single spaces between them: line breaks and punctuation don't matter."""
    return _PLAIN.sub(" ", text.lower()).strip()


def parse_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(text without quotes, passages): a passage is a run of lines with one level, cut at empty lines.

    Level 0 is the message's own text. A line that announces a quote and stands before one is dropped.
    """
    own, passages, run, level = [], [], [], 0

    def close():
        if run and normal_passage(" ".join(run)):
            passages.append((level, "\n".join(run)))
        run.clear()

    for line in text.split("\n"):
        marks = _MARKS.match(line)
        now = marks.group().count(">") if marks else 0
        content = line[marks.end() :] if marks else line
        if now and not level and own and _ANNOUNCES.match(own[-1]):
            own.pop()
            if run:
                run.pop()
        if now != level or not content.strip():
            close()
        level = now
        if content.strip():
            run.append(content)
        if not now:
            own.append(line)
    close()
    return "\n".join(own).strip("\n"), passages


def pieces_of(passages: list[tuple[int, str]], own: str) -> list[tuple[int, int, int]]:
    """(level, words, hash) of each passage and of its lines, and of the whole own text."""
    found = {}
    texts = [(0, own)] + [(level, x) for level, text in passages for x in (text, *text.split("\n"))]
    for level, text in texts:
        plain = normal_passage(text)
        if plain:
            found[level, xxhash.xxh3_64_intdigest(plain)] = plain.count(" ") + 1
    return [(level, words, h - 2**64 if h >= 2**63 else h) for (level, h), words in found.items()]


def _parsed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owns, levels, pieces = [], [], []
        for text in batch.column("text"):
            own, passages = parse_quotes(text.as_py() or "")
            owns.append(own)
            levels.append(max([0, *(level for level, _ in passages)]))
            pieces.append([dict(zip(("level", "words", "hash"), p)) for p in pieces_of(passages, own)])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("words", pa.int32()), ("hash", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in batch.schema.names if c != "text"],
                pa.array(owns, pa.string()), pa.array(levels, pa.int32()), pa.array(pieces, kind),
            ],
            [*[c for c in batch.schema.names if c != "text"], "own", "levels", "pieces"],
        )


def _previous_turns(turns: DataFrame) -> DataFrame:
    """(conv, turn, previous): the turn before in the conversation, found in spans of SPAN turns.

    The last turn of each span is carried to the next one, so no window holds a whole conversation.
    """
    span = F.floor(F.col("turn") / SPAN)
    turns = turns.select("conv", "turn").distinct().withColumn("span", span)
    lasts = turns.groupBy("conv", "span").agg(F.max("turn").alias("last"))
    carried = lasts.withColumn("carried", F.lag("last").over(Window.partitionBy("conv").orderBy("span"))).drop("last")
    inside = F.lag("turn").over(Window.partitionBy("conv", "span").orderBy("turn"))
    return (
        turns.withColumn("inside", inside).join(carried, ["conv", "span"])
        .select("conv", "turn", F.coalesce("inside", "carried").alias("previous"))
    )


def _depths(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) by pointer jumping: every round doubles the steps that a message has gone up."""
    at = cut_lineage(
        parents.select(
            "conv", "turn", F.coalesce("parent", "turn").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"),
            F.col("parent").isNull().alias("done"),
        )
    )
    while not at.where("not done").isEmpty():
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        # messages that have reached their root are looked at no more
        moved = at.where("not done").join(up, ["conv", "root"]).select(
            "conv", "turn", F.col("next").alias("root"), F.col("depth") + F.col("more"), F.col("ends").alias("done")
        )
        at = cut_lineage(at.where("done").union(moved))
    return at.drop("done")


def link_quotes(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    least_words: int = 3,
) -> DataFrame:
    """One row for each row of `df`: where it stands in its conversation, and its text without quotes.

    Quote levels are the > marks of a line. Passages (runs of lines of one level) and their lines are
    normalised and hashed; so are the own passages of all messages. A quoted piece of `least_words` words or more
    is joined to the first message of its conversation that wrote it, if that comes earlier. The parent
    of a message is the source of most words of its lowest linked level, the later one if two are equal; without
    a link it is the turn before. `root` and `depth` follow from the parents, and (conv, root, depth, turn) orders the replies: a
    message comes after the one it answers.

    Columns: conv and turn under their names, role, parent_turn, linked_by (quote, order or null for
    the first), linked_turns (all sources), n_levels, root_turn, depth, text. Rows with equal conversation and turn
    share a place; a missing conversation is one of its own, a missing turn comes last; a missing or empty text
    has no pieces, an empty table no rows. Other columns are not read.
    """
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit("\x00"))
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST_TURN))
    kinds = dict(df.dtypes)
    messages = df.select(
        conv.alias("conv"), turn.alias("turn"), F.col(conv_col).alias("conv_was"), F.col(turn_col).alias("turn_was"),
        F.col(role_col).alias("role"), F.col(text_col).alias("text"),
    )
    schema = (
        f"conv string, turn long, conv_was {kinds[conv_col]}, turn_was {kinds[turn_col]}, role {kinds[role_col]}, "
        "own string, levels int, pieces array<struct<level:int,words:int,hash:bigint>>"
    )
    parsed = cut_lineage(messages.mapInArrow(_parsed_rows, schema))
    pieces = parsed.select("conv", "turn", F.explode("pieces").alias("p")).select("conv", "turn", "p.*").where(F.col("words") >= least_words)
    # only what somebody quotes is looked for
    quoted = pieces.where("level > 0").groupBy("conv", "hash", "turn", "level").agg(F.max("words").alias("words"))
    first = cut_lineage(pieces.where("level = 0").groupBy("conv", "hash").agg(F.min("turn").alias("source")))
    links = quoted.join(first, ["conv", "hash"]).where("source < turn")
    by_source = links.groupBy("conv", "turn", "level", "source").agg(F.sum("words").alias("words"))
    best = by_source.groupBy("conv", "turn").agg(
        F.max_by("source", F.struct(-F.col("level"), F.col("words"), F.col("source"))).alias("linked"),
        F.sort_array(F.collect_set("source")).alias("linked_turns"),
    )
    places = cut_lineage(
        _previous_turns(parsed).join(best, ["conv", "turn"], "left")
        .withColumns(
            {
                "parent": F.coalesce("linked", "previous"),
                "linked_by": F.when(F.col("linked").isNotNull(), "quote").when(F.col("previous").isNotNull(), "order"),
            }
        )
    )
    depths = _depths(places)
    shown = lambda c: F.when(F.col(c) != LAST_TURN, F.col(c))
    return (
        parsed.drop("pieces").join(places, ["conv", "turn"]).join(depths, ["conv", "turn"])
        .select(
            F.col("conv_was").alias(conv_col), F.col("turn_was").alias(turn_col), F.col("role").alias(role_col),
            shown("parent").alias("parent_turn"), "linked_by", F.coalesce("linked_turns", F.array().cast("array<bigint>")).alias("linked_turns"),
            F.col("levels").alias("n_levels"), shown("root").alias("root_turn"), "depth", F.col("own").alias(text_col),
        )
    )


def reply_order(conv: str = "conv_id", turn: str = "turn") -> list[Column]:
    """Sort keys under which every message comes after the one it answers."""
    return [F.col(conv), F.col("root_turn"), F.col("depth"), F.col(turn)]
