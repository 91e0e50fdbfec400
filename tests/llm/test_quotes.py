"""Quotation linking on a hand-made conversation and against a direct computation."""

from mintweave.llm import quotes


def run(spark, rows):
    table = spark.createDataFrame([(c, t, r, x, "y", 1) for c, t, r, x in rows], "conv_id long, turn int, role string, text string, level string, chars int")
    return {(r["conv_id"], r["turn"]): r for r in quotes.conversations(table).collect()}


def test_links(spark):
    rows = [
        (1, 0, "user", "How do I join tables?\n\nThey are large."),
        (1, 1, "assistant", "Use an equi-join.\nAvoid cross joins."),
        (1, 2, "user", "Something else entirely"),
        (1, 3, "assistant", "On Monday, A wrote:\n> How do I  JOIN tables?\n\nAs I said."),
        (1, 4, "user", "> Use an equi-join.\n> Avoid cross joins.\n>> They are large.\nThanks"),
        (1, 5, "user", "> never said\nok"),
        (2, 0, "user", "How do I join tables?"),
        (2, 1, "user", "> How do I join tables?\nyes"),
        (3, 7, None, None), (3, 9, "user", ""), (3, 9, "user", ""), (None, 1, "user", "x"), (4, None, "user", "x"),
    ]
    got = run(spark, rows)
    assert {k: r["reply_to"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 1, (1, 5): 4, (2, 0): None, (2, 1): 0, (3, 7): None, (3, 9): 7}
    assert got[1, 4]["quoted_turns"] == [0, 1] and got[1, 5]["quoted_turns"] == []
    assert got[1, 3]["text"] == "As I said." and got[1, 4]["text"] == "Thanks"
    assert {k: r["depth"] for k, r in got.items() if k[0] == 1} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 2, (1, 5): 3}
    assert all(r["thread"] == (7 if c == 3 else 0) for (c, _), r in got.items())


def test_rewrapped_passage(spark):
    got = run(spark, [(1, 0, "a", "one two three\nfour five six"), (1, 1, "b", "other"), (1, 2, "a", "> one two\n> three four\n> five six\nyes"), (1, 3, "a", "> Other\n" * 20000)])
    assert got[1, 2]["reply_to"] == 0 and got[1, 3]["reply_to"] == 1 and got[1, 3]["text"] == ""


def test_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = quotes.conversations(table)
    assert got.count() == table.count()
    assert got.filter("reply_to is null").count() == table.select("conv_id").distinct().count()


def test_empty(spark):
    assert quotes.conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_every_row_stays(spark):
    rows = [
        (1, 0, "user", "first question"), (1, 0, "user", "second question"), (1, 0, "user", "second question"), (1, 1, "bot", "> first question\nanswer"),
        (1, 1, "bot", "> second question\nanother"), (1, 2, "user", "thanks"), (None, 0, "user", "> first question\nlost"), (None, 0, "user", "alone"), (1, None, "user", "no turn"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = quotes.conversations(table, unplaced=True).collect()
    assert sorted(r["text"] for r in got) == sorted(["first question", "second question", "second question", "answer", "another", "thanks", "lost", "alone", "no turn"])
    at = {(r["turn"], r["part"]): r for r in got if r["conv_id"] == 1 and r["turn"] is not None}
    assert sorted(at) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)]
    for r in at.values():
        above = at.get((r["reply_to"], r["reply_part"]))
        assert (above is None) == (r["turn"] == 0) and r["depth"] == r["turn"]
        assert above is None or (r["thread"], r["thread_part"]) == (above["thread"], above["thread_part"])
        if r["text"] in ("answer", "another"):
            assert above["text"] == {"answer": "first question", "another": "second question"}[r["text"]]
    assert all(r["reply_to"] is None and r["depth"] == 0 and r["quoted_turns"] == [] for r in got if r["conv_id"] is None or r["turn"] is None)


def test_long_conversation(spark):
    n = quotes.TURNS + 50  # over more than one bucket of turns
    rows = [(1, t, "u", f"> said {t - 3000}\nsaid {t}" if t in (3500, n - 1) else f"said {t}") for t in range(n)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["thread"], r["depth"]) for r in quotes.conversations(table).collect()}
    depth = {0: 0}
    for t in range(1, n):
        above = t - 3000 if t in (3500, n - 1) else t - 1
        depth[t] = depth[above] + 1
        assert got[t] == (above, 0, depth[t])
    assert got[0] == (None, 0, 0)
