from tablewright.llm.chat_quotes import link_quotes, parse_quotes, reply_order


def test_quote_levels():
    own, passages = parse_quotes("Yes.\nBob wrote:\n> first line\n> second line\n> > deeper\n>\n>other\n\nThanks")
    assert own == "Yes.\n\nThanks"
    assert passages == [(0, "Yes."), (1, "first line\nsecond line"), (2, "deeper"), (1, "other"), (0, "Thanks")]


ROWS = [
    (1, 0, "user", "How do I sort a very long list?"),
    (1, 1, "assistant", "> How do I sort a\n> very LONG list?\nCall sorted on it.\nIt returns a new list."),
    (1, 2, "user", "Is there another way to do it"),
    (1, 3, "user", "On Monday Ann wrote:\n> It returns a new list.\n>> How do I sort a very long list?\nCan it be in place?"),
    (1, 4, "user", "> never written anywhere here\nWhat now?"),
    (2, 5, "user", "> How do I sort a very long list?\nnot from this conversation"),
    (2, 2000, "user", "> not from this\n> conversation\nfar away"),
    (None, 0, "user", None),
    (None, None, "user", ""),
    (1, 2, "user", "Is there another way to do it"),
]


def linked(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' own", "1 depth")
    return link_quotes(df)


def test_quotes_are_linked_to_their_sources(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in linked(spark).collect()}
    parents = {k: (r["parent_turn"], r["linked_by"]) for k, r in rows.items()}
    assert parents == {
        (1, 0): (None, None), (1, 1): (0, "quote"), (1, 2): (1, "order"), (1, 3): (1, "quote"), (1, 4): (3, "order"),
        (2, 5): (None, None), (2, 2000): (5, "quote"), (None, 0): (None, None), (None, None): (0, "order"),
    }
    assert rows[1, 3]["linked_turns"] == [0, 1] and rows[1, 3]["n_levels"] == 2
    assert rows[1, 3]["text"] == "Can it be in place?"
    assert rows[1, 1]["text"] == "Call sorted on it.\nIt returns a new list."


def test_replies_follow_what_they_answer(spark):
    rows = linked(spark).orderBy(*reply_order()).where("conv_id = 1").collect()
    seen = []
    for r in rows:
        assert r["parent_turn"] is None or r["parent_turn"] in seen
        seen.append(r["turn"])
    assert [r["depth"] for r in rows] == sorted(r["depth"] for r in rows)
    assert len(rows) == 6 and linked(spark).count() == len(ROWS)


def test_deep_conversations(spark):
    rows = [(7, 3 * k, "user", f"message number {k} of them") for k in range(3000)]
    found = {r["turn"]: r for r in linked(spark, rows).collect()}
    assert all(found[3 * k]["depth"] == k and found[3 * k]["root_turn"] == 0 for k in (0, 1, 1023, 1024, 2999))


def test_nothing_in_nothing_out(spark):
    assert linked(spark, []).count() == 0
