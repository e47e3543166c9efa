import hashlib
import random
import time

import pytest

from tablewright.llm.secret_scan import find_candidates, rule_labels, secret_features, secret_scan, train_forest


@pytest.fixture(scope="module")
def texts(spark):
    token = lambda k: hashlib.sha1(str(k).encode()).hexdigest()
    card = lambda k: str(10**15 + k * 7919)
    filler = "the quick brown fox reads many words again and again " * 3
    rows = []
    for k in range(60):
        rows.append((k, f"{filler}\ntoken = \"{token(k)}\" {filler}", "src/app"))
        rows.append((100 + k, f"{filler} {card(k)} {filler}", "src/app"))
        rows.append((200 + k, f"{filler} see http://host/{token(1000 + k)[:20]}/page {filler}", "docs/example"))
    rows += [(900, None, "x"), (901, "", None), (None, f"token = \"{token(7)}\"", None), (902, "api_key = \"your_example_key_000000\"", "tests/x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 value", "'x' line")


def test_candidates_are_found_by_line(texts):
    rows = find_candidates(texts).collect()
    assert {r["id"] for r in rows} >= {*range(60), *range(100, 160), *range(200, 260), None, 902}
    assert all(r["line"] == 1 for r in rows if r["id"] is not None and r["id"] < 60)


def test_forest_on_held_out_findings(texts):
    rows = rule_labels(secret_features(texts)).where("label is not null and id is not null")
    forest = train_forest(rows.where("id % 3 <> 0"))
    from pyspark.ml.feature import VectorAssembler

    from tablewright.llm.secret_scan import FEATURES

    test = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.where("id % 3 = 0"))
    right = forest.transform(test).selectExpr("avg(cast(prediction = label as int))").first()[0]
    assert right >= 0.98


def test_secrets_and_false_positives(texts):
    rows = secret_scan(texts).collect()
    secret = {r["doc_id"] for r in rows if r["secret"]}
    assert secret >= set(range(60)) | {None}
    assert not secret & (set(range(100, 160)) | set(range(200, 260)) | {902})


def test_findings_can_be_given(texts):
    findings = find_candidates(texts).selectExpr("id", "line", "nth", "cast(id between 100 and 159 as int) label")
    rows = secret_scan(texts, findings=findings).collect()
    assert {r["doc_id"] for r in rows if r["secret"]} == set(range(100, 160))


def test_empty_tables_and_one_kind(nothing, texts):
    assert secret_scan(nothing).count() == 0
    only = secret_scan(texts.where("doc_id < 60"))
    assert only.where("secret").count() == only.count() == 60


def test_each_place_has_its_own_surroundings(spark):
    token = hashlib.sha1(b"twice").hexdigest()
    lines = [
        f'see http://host/page.{token} and then token = "{token}", end',
        f"x{token}y, token: '{token}'",  # within a longer run first
        f"\u2028key=({token}) {'word ' * 30}key=({token})",
    ]
    df = spark.createDataFrame([(1, "\n".join(lines), "src")], "doc_id long, text string, source string")
    rows = rule_labels(find_candidates(df).where(f"value = '{token}'")).collect()
    places = [(0, lines[0].index(token)), *((k, x.rindex(token)) for k, x in enumerate(lines)), (2, lines[2].index(token))]
    around = lambda x, at: (x[max(0, at - 40) : at], x[at + len(token) :][:40])
    assert sorted((r["line"], r["before"], r["after"]) for r in rows) == sorted((k, *around(lines[k], at)) for k, at in places)
    assert sorted(r["label"] for r in rows if r["line"] == 0) == [0.0, 1.0]


def test_repeats_of_a_given_table_are_reported(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id = 1110")
    rows = find_candidates(docs).groupBy("line", "value").count().where("count > 1")
    assert rows.count() >= 1


def places_by_hand(line):
    """(start, value) of all candidates of a line, character by character."""
    found = []
    run = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
    at = 0
    while at < len(line):
        end = at
        while end < len(line) and line[end] in run:
            end += 1
        if end - at >= 16 and any(c in "0123456789" for c in line[at:end]):
            found.append((at, line[at:end]))
        at = max(end, at + 1)
    names, word = ("passw", "auth", "credential", "key", "token", "secret", "pwd"), set(run) - set("+/=-")
    at = 0
    while at < len(line):
        for name in names:
            if line[at : at + len(name)].lower() != name:
                continue
            end = at + len(name)
            while name in names[:3] and end < len(line) and line[end] in word:
                end += 1
            end += line[end : end + 1] in ("'", '"')
            spaces = 0
            while spaces < 3 and line[end : end + 1] == " ":
                end, spaces = end + 1, spaces + 1
            if line[end : end + 1] not in ("=", ":"):
                continue
            end, spaces = end + 1, 0
            while spaces < 3 and line[end : end + 1] == " ":
                end, spaces = end + 1, spaces + 1
            end += line[end : end + 1] in ("'", '"')
            start = end
            while end < len(line) and line[end] not in " '\"":
                end += 1
            if end - start >= 8:
                found.append((start, line[start:end]))
                at = end - 1
                break
        at += 1
    out = set()
    for start, value in found:
        inner = value.lstrip("\"'(")
        kept = inner.rstrip("\"'),.;#&%$*!?")
        if len(kept) >= 8:
            out.add((start + len(value) - len(inner), kept))
    return sorted(out)


def test_candidates_equal_a_scan_by_hand(spark):
    rng = random.Random(21)
    parts = ["token", "KEY", "auth", "author", "password_2", "mysecret", "pwdx", "credentials", "=", ":", " = ", ": ", '"', "'", " ", "  ", "x" * 20,
             "abcdef0123456789abc", "0" * 15, "A1" * 9, "+/", "(val12345)", "value,8!", "http://host/a9/", "é", "a-b_c=d/e+f-g_h=1", "   :    "]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {}
    for r in find_candidates(df, path_col=None).collect():
        found.setdefault(r["id"], []).append((r["value"], r["before"], r["after"]))
    for k, line in enumerate(lines):
        expected = [(v, line[max(0, at - 40) : at], line[at + len(v) :][:40]) for at, v in places_by_hand(line)]
        assert sorted(found.get(k, [])) == sorted(expected), line


@pytest.mark.parametrize("piece", ["x", "auth", "ab-CD_", "key=", "abcdefgh12345678 "])
def test_a_line_of_a_megabyte(spark, piece):
    line = piece * (1_000_000 // len(piece))
    df = spark.createDataFrame([(1, line + "!1", "src")], "doc_id long, text string, source string")
    start = time.monotonic()
    n = find_candidates(df).count()
    assert n == {"key=": 1, "abcdefgh12345678 ": len(line) // 17}.get(piece, 0)
    assert time.monotonic() - start < 60
