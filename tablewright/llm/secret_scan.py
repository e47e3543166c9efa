"""Secret scan: candidates by pattern, false ones removed by a random forest. DataFrame operations and Spark ML only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: A whole run of 16 or more letters, digits and + / = _ -; one with a digit is a candidate. No pattern here looks twice at a place of a
#: long run: quantifiers are possessive, and what starts with a word starts at the word's first letter.
RUN = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{16,}+"
TELLING = r"(?i)(key|token|secret|passw|pwd|auth|credential|private|bearer|access)"
#: What is assigned to a telling name.
ASSIGNED = (
    r"(?i)(?<!\w)(?=\w*?(?:passw|auth|credential|(?:key|token|secret|pwd)(?!\w)))\w++"
    r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,}+)"
)
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|test|xxxx|\*\*\*)"
#: Formats of keys that say what they are.
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})$"

FEATURES = [
    "length", "changes", "change_share", "transition", "coverage", "digit_share", "upper_share", "entropy", "hex",
    "in_path", "slashes", "doubtful_path", "telling_before", "assigned", "quoted", "placeholder",
]


#: Pieces beside a match that 40 characters around it reach into: a match has eleven characters or more.
BESIDE = 4
#: Lengths that are added up at a time.
BLOCK = 256


def _ends(lengths: Column) -> Column:
    """Sums of the lengths so far, with a 0 before them; block by block, as every addition to an array copies it."""

    def block(ends: Column, start: Column) -> Column:
        sums = F.aggregate(
            F.slice(lengths, start + 1, F.lit(BLOCK)), F.array(F.element_at(ends, -1)),
            lambda so_far, n: F.concat(so_far, F.array(F.element_at(so_far, -1) + n)),
        )
        return F.concat(ends, F.slice(sums, 2, BLOCK))

    last = F.greatest(F.size(lengths) - 1, F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), last, F.lit(BLOCK)), F.array(F.lit(0)), block)


def _places(lines: DataFrame, pattern: str, name: str) -> DataFrame:
    """Add `name`: (at, value, before, after) of every match in `content`. The value is the pattern's only group, which ends the match, without
    marks around it. Lines are cut at the matches, so a long line is not read again for each of them."""
    # a match with the text since the last one, so lengths add up to places; after the last one no other start is tried
    pieces, values = (F.regexp_extract_all("content", F.lit(rf"\G(?s).*?{pattern}"), F.lit(k)) for k in (0, 1))
    cut = lines.withColumns({"__pieces": pieces, "__values": values})
    cut = cut.withColumn("__lengths", F.transform("__pieces", F.length)).withColumn("__ends", _ends(F.col("__lengths")))
    rest = F.substring(F.col("content"), F.element_at("__ends", -1) + 1, F.lit(40))
    cut = cut.withColumn("__pieces", F.concat("__pieces", F.array(rest)))

    def around(first: Column, last: Column) -> Column:
        return F.array_join(F.slice("__pieces", first, last - first + 1), "")

    def place(raw: Column, i: Column) -> Column:
        inner = F.regexp_replace(raw, r"^[\"'(]+", "")
        value = F.regexp_replace(inner, r"[\"'),.;#&%$*!?]+$", "")
        piece, end = F.get("__pieces", i), F.get("__ends", i + 1)
        own = F.substring(piece, F.lit(1), F.length(piece) - F.length(inner))
        # numbers from 1 in slices
        earlier = around(F.greatest(i + 1 - BESIDE, F.lit(1)), i)
        later = around(i + 2, i + 1 + BESIDE)
        return F.struct(
            (end - F.length(inner) + 1).alias("at"), value.alias("value"), F.right(F.concat(earlier, own), F.lit(40)).alias("before"),
            F.left(F.concat(F.substring(inner, F.length(value) + 1, F.lit(40)), later), F.lit(40)).alias("after"),
        )

    return cut.withColumn(name, F.transform("__values", place)).drop("__pieces", "__values", "__lengths", "__ends")


def find_candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row for each candidate: id, path, line (number), nth (in the line), value, before, after.

    Lines are looked at one by one; `before` and `after` are up to 40 characters around the value. A
    value that a line holds twice counts twice, each time with the surroundings of its own place; a place
    that both patterns find counts once. A very long line is read a few times, however many candidates it holds.
    """
    path = F.lit("") if path_col is None else F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    lines = df.select(
        F.col(id_col).alias("id"), path.alias("path"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line", "content")
    )
    # the short patterns spare most lines the long ones
    has_run = F.col("content").rlike("[0-9]") & F.col("content").rlike(RUN)
    has_name = F.col("content").rlike("[=:]") & F.col("content").rlike(ASSIGNED)
    found = _places(_places(lines.where(has_run | has_name), f"({RUN})", "runs"), ASSIGNED, "assigned")
    runs = F.filter("runs", lambda place: place["value"].rlike("[0-9]"))
    # a value that is a whole run with a digit is there as such
    others = F.filter(
        "assigned",
        lambda place: ~(
            place["value"].rlike(r"^[A-Za-z0-9+/=_\-]{16,}+$") & place["value"].rlike("[0-9]")
            & ~place["before"].rlike(r"[A-Za-z0-9+/=_\-]$") & ~place["after"].rlike(r"^[A-Za-z0-9+/=_\-]")
        ),
    )
    return (
        found.select("id", "path", "line", F.posexplode(F.concat(runs, others)).alias("nth", "place"))
        .select("id", "path", "line", "nth", "place.value", "place.before", "place.after")
        .where(F.length("value") >= 8)
    )


def corpus_dictionary(df: DataFrame, text_col: str = "text", least: int = 5) -> DataFrame:
    """(word, n): lower-case words of three letters or more that occur `least` times or more in all texts."""
    words = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word"))
    return words.where("length(word) between 3 and 40").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, i, F.lit(2)))


def character_transitions(dictionary: DataFrame) -> DataFrame:
    """(pair, weight): log-probability of the second letter after the first in the dictionary, a to z only."""
    pairs = (
        dictionary.where(F.col("word").rlike("^[a-z]{3,}$"))
        .select(F.explode(_pairs(F.col("word"))).alias("pair"))
        .groupBy("pair").agg(F.count("*").alias("n"))
    )
    first = F.substring("pair", 1, 1)
    totals = pairs.groupBy(first.alias("first")).agg(F.sum("n").alias("total"))
    return pairs.join(totals, first == F.col("first")).select("pair", F.log((F.col("n") + 1) / (F.col("total") + 26)).alias("weight"))


def value_features(values: DataFrame, dictionary: DataFrame, transitions: DataFrame) -> DataFrame:
    """Features of distinct values: shape, letter transitions and the share of letters in dictionary words."""
    value = F.col("value")
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    # words: runs of letters, cut where a small letter meets a capital
    runs = F.filter(
        F.split(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+"), lambda w: F.length(w) >= 3
    )
    covered = (
        values.select("value", F.explode(runs).alias("word"))
        .join(dictionary.select("word"), "word")
        .groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    )
    # at most 676 pairs
    surprise = (
        values.select("value", F.explode(F.when(F.length(letters) > 1, _pairs(letters)).otherwise(F.array())).alias("pair"))
        .join(F.broadcast(transitions), "pair", "left")
        .groupBy("value").agg(F.avg(F.coalesce("weight", F.lit(-6.0))).alias("transition"))
    )
    changes = F.regexp_count(
        value, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    )
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.length(value).cast("double")
    entropy = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda total, c: total - (F.size(F.filter(chars, lambda x: x == c)) / size) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / size),
    )
    return (
        values.join(covered, "value", "left").join(surprise, "value", "left")
        .select(
            "value",
            size.alias("length"),
            changes.cast("double").alias("changes"),
            (changes / size).alias("change_share"),
            F.coalesce("transition", F.lit(-6.0)).alias("transition"),
            (F.coalesce("covered", F.lit(0)) / F.greatest(F.length(F.regexp_replace(value, r"[^\p{L}]", "")), F.lit(1))).alias("coverage"),
            (F.regexp_count(value, F.lit("[0-9]")) / size).alias("digit_share"),
            (F.regexp_count(value, F.lit("[A-Z]")) / size).alias("upper_share"),
            entropy.alias("entropy"),
            value.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"),
        )
    )


def place_features() -> dict[str, Column]:
    """Features of where a value stands: path, neighbouring words, assignment."""
    before = F.col("before")
    yes = lambda c: c.cast("double")
    return {
        "in_path": yes(before.rlike(r"(://\S*|/)$") | F.col("value").rlike(r"^/|/.*/")),
        "slashes": F.regexp_count("value", F.lit("/")).cast("double"),
        "doubtful_path": yes(F.col("path").rlike(r"(?i)(test|example|sample|doc|vendor|fixture)")),
        "telling_before": yes(before.rlike(TELLING)),
        "assigned": yes(before.rlike(r"(?<!http)(?<!https)[=:]\s{0,3}[\"']?$")),
        "quoted": yes(before.rlike(r"[\"']$") & F.col("after").rlike(r"^[\"']")),
        "placeholder": yes(F.concat_ws(" ", "before", "value", "after").rlike(PLACEHOLDER)),
    }


def rule_labels(candidates: DataFrame) -> DataFrame:
    """Labelled findings by strict rules; the rest has no label.

    1: a known key format, or a value assigned to a telling name that has letters and digits and is no
    placeholder. 0: digits only, a placeholder, or part of a path or address.
    """
    telling = F.col("before").rlike(TELLING + r"\W{0,4}[=:]\W{0,4}$")
    mixed = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & (F.length("value") >= 16)
    fake = F.concat("before", "value").rlike(PLACEHOLDER)
    return candidates.withColumn(
        "label",
        F.when(F.col("value").rlike(KNOWN) | (telling & mixed & ~fake), 1.0)
        .when(F.col("value").rlike("^[0-9]+$|^/|//") | fake | F.col("before").rlike(r"(://\S*|[/@])$"), 0.0),
    )


def train_forest(labelled: DataFrame, most_rows: int = 20_000, trees: int = 40, depth: int = 8, seed: int = 7) -> RandomForestClassificationModel | None:
    """A random forest from rows with FEATURES and label; None unless both labels occur.

    At most about `most_rows` rows of each label are used, chosen by a hash of the row: this bounds the
    classifier's sample and nothing else.
    """
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    share = F.when(F.col("label") == 1.0, min(1.0, most_rows / counts[1.0])).otherwise(min(1.0, most_rows / counts[0.0]))
    chosen = labelled.where(F.pmod(F.xxhash64(*FEATURES), F.lit(2**31)) / 2.0**31 <= share)
    weight = F.when(F.col("label") == 1.0, 1.0 / counts[1.0]).otherwise(1.0 / counts[0.0]) * min(counts.values())
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen.withColumn("weight", weight))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(rows.select("features", "label", "weight"))


def secret_features(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", dictionary: DataFrame | None = None
) -> DataFrame:
    """Candidates of `df` with all FEATURES; the dictionary is that of all texts of `df` unless one is given."""
    candidates = cut_lineage(find_candidates(df, id_col, text_col, path_col))
    dictionary = cut_lineage(corpus_dictionary(df, text_col)) if dictionary is None else dictionary
    values = candidates.select("value").distinct()
    features = value_features(values, dictionary, cut_lineage(character_transitions(dictionary)))
    return cut_lineage(candidates.join(cut_lineage(features), "value").withColumns(place_features()))


def secret_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    findings: DataFrame | None = None,
    threshold: float = 0.5,
    most_rows: int = 20_000,
) -> DataFrame:
    """One row for each candidate: id, line, nth, value_sha256, length, probability and secret.

    Candidates come from patterns, so that nothing with a plain shape is missed; the forest removes false
    positives. It looks at the value's length, its changes between character classes and its letter
    transitions against the corpus' words, the share of it that dictionary words cover, the path of
    the document and of the value, and the words around it. It learns from `findings` (columns id, line,
    nth, label 0 or 1), or from `rule_labels` where none are given. Features of a value are formed once,
    however often it occurs. With labels of one kind only, the strict rules decide alone.

    A missing or empty text has no candidates; missing ids and paths are kept as they are; repeated rows
    give repeated findings; an empty table gives no rows. Other columns are not read.
    """
    rows = secret_features(df, id_col, text_col, path_col)
    labelled = rule_labels(rows)
    if findings is not None:
        known = findings.select("id", "line", "nth", F.col("label").cast("double").alias("label")).distinct()
        labelled = rows.join(known, ["id", "line", "nth"])
    forest = train_forest(labelled.where("label is not null"), most_rows)
    if forest is None:
        scored = rule_labels(rows).withColumn("probability", F.coalesce("label", F.lit(0.0)))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
        scored = forest.transform(vectors).withColumn("probability", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col), "line", "nth", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("int").alias("length"),
        F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("secret"),
    )
