import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, doc string"


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" + rng.choice(["", ",", "."]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with every odd case: (doc_id, text, lang, source)."""
    rng = random.Random(4)
    passage = " ".join(words(rng, 70))
    base = words(rng, 300)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(rng, rng.randint(1, 160))), "en", f"s{i % 3}"))
    for i in range(40, 52):  # near copies, ids out of order
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        rows.append((91 - i, " ".join(copy), "en", "s0"))
    for i in range(60, 66):  # a shared passage within other words, twice in one of them
        rows.append((i, " ".join([*words(rng, 30), passage, *words(rng, 30), *([passage] if i == 63 else [])]), "de", "s1"))
    rows += [(70, None, None, None), (71, "", "en", "s1"), (72, " \n\t ", "en", None), (None, passage, "en", "s2"), (None, None, None, "s2")]
    rows += [(5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (6, "another text under a known id", "fr", "s0")]
    rows += [(80, "same " * 3000, "en", "s0"), (81, "ab" * 900, "en", "s0"), (82, passage, "en", "s9"), (83, passage, "en", "s9")]
    rows += [(90, " ".join(words(rng, 20_000, 10**6)), "en", "s1"), (91, "naïve façade é ß 漢字\n" * 30, "fr", "s1")]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with extra columns named like those that operators add."""
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "y", "z") for i, t, lang, s in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
