"""Chat formatting by quotation linking.

A message's lines are split by quote level (leading ``>`` marks).  Runs of lines of one level are passages;
a passage is normalised (marks and case dropped, white space closed up) and hashed, as a whole and line by
line.  What a message says itself (level 0) is hashed the same way.  A quoted passage or line links to the
latest earlier message of the conversation that says it; a message replies to the message from which it
quotes the most characters at level 1, else to the message before it.  Messages lose their quoted lines and
the attribution line ("On ... wrote:") above them.

DataFrame functions only.  Finding the latest earlier message is one ordered pass per hashed passage, not a
join of all sayers with all quoters, and depths come from pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave.operators.skew import last_before, ordered_position, previous_row
from mintweave.session import cut

#: A message: its row, and its place in the conversation.
KEYS = ("_row", "conv_id", "turn", "_tie")
#: Turns of a conversation that are ordered in one task.
TURNS = 4096

MARKS = r"^[ \t]*(>[ \t]?)+"
ATTRIBUTION = r"(?i)^[ \t]*(on\b.*|.*)\bwrote:[ \t]*$"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\x20\x09-\x0D]+", " "))


def level(line: Column) -> Column:
    """Number of leading quote marks."""
    found = F.regexp_extract(line, MARKS, 0)
    return F.length(found) - F.length(F.regexp_replace(found, ">", ""))


def split_lines(messages: DataFrame) -> DataFrame:
    """Adds ``_lines``: array of (level, raw, said) per message, attribution lines at level -1."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), r"\r?\n")
    marked = F.transform(lines, lambda s: F.struct(level(s).alias("level"), s.alias("raw"), normalised(s).alias("said")))
    out = messages.withColumn("_marked", marked)
    ahead = lambda i: F.coalesce(F.get(F.col("_marked"), i + 1)["level"], F.lit(0))
    kind = lambda x, i: F.when((x["level"] == 0) & x["raw"].rlike(ATTRIBUTION) & (ahead(i) > 0), F.lit(-1)).otherwise(x["level"])
    return out.withColumn("_lines", F.transform("_marked", lambda x, i: F.struct(kind(x, i).alias("level"), x["raw"].alias("raw"), x["said"].alias("said")))).drop("_marked")


def passages() -> Column:
    """Whole runs of one level with a blank line or another level between them: (level, said)."""
    one = F.struct(F.lit(None).cast("int").alias("level"), F.lit("").alias("said"))
    start = F.struct(F.array().cast("array<struct<level:int,said:string>>").alias("done"), one.alias("run"))

    def closed(state: Column) -> Column:
        return F.when(state["run"]["said"] != "", F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"])

    def step(state: Column, x: Column) -> Column:
        same = (x["level"] == state["run"]["level"]) & (x["said"] != "")
        longer = F.struct(state["run"]["level"].alias("level"), F.concat_ws(" ", F.nullif(state["run"]["said"], F.lit("")), x["said"]).alias("said"))
        return F.when(same, F.struct(state["done"].alias("done"), longer.alias("run"))).otherwise(F.struct(closed(state).alias("done"), F.struct(x["level"].alias("level"), x["said"].alias("said")).alias("run")))

    return F.aggregate("_lines", start, step, closed)


def hashed(messages: DataFrame) -> DataFrame:
    """``_row, conv_id, turn, _tie, level, hash, chars`` of every passage and every line, each once per message and level."""
    lines = F.transform("_lines", lambda x: F.struct(x["level"].alias("level"), x["said"].alias("said")))
    every = F.filter(F.concat(lines, passages()), lambda x: (x["said"] != "") & (x["level"] >= 0))
    rows = messages.select(*KEYS, F.explode(every).alias("p"))
    return rows.groupBy(*KEYS, F.col("p.level").alias("level"), F.xxhash64("p.said").alias("hash")).agg(F.max(F.length("p.said")).alias("chars"))


def links(messages: DataFrame) -> DataFrame:
    """``_row, level, original, passages, chars``: quoting message and the message (turn, _tie, _row) it quotes at that level."""
    found = cut(hashed(messages), "passages").withColumn("_key", F.struct("conv_id", "hash"))
    quoting = found.filter("level > 0")
    saying = found.filter("level = 0").join(quoting.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    at = last_before(quoting, saying, on="_key", order=["turn"], ties=["_tie", "_row"], payload=["turn", "_tie", "_row"], out="original", width=TURNS)
    return at.filter("original is not null").groupBy("_row", "level", "original").agg(F.count(F.lit(1)).alias("passages"), F.sum("chars").cast("long").alias("chars"))


def threads(linked: DataFrame) -> DataFrame:
    """``_row, reply, thread, depth`` from ``_row, at, reply`` (``at``, ``reply``: turn, _tie, _row), by pointer doubling.

    A message leaves the doubling as soon as its pointer is known to be the first of its thread, so the messages of a
    long thread never meet on the one key of its beginning.
    """
    root = F.col("reply").isNull()
    state = linked.select("_row", "reply", F.coalesce("reply", "at").alias("thread"), (~root).cast("long").alias("depth"), root.alias("done"))
    state = cut(state, "replies")
    while state.filter("not done").limit(1).count():
        up = state.select(F.col("_row").alias("_above"), F.col("thread").alias("above"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = state.filter("not done").join(up, F.col("thread._row") == F.col("_above"))
        moved = step.select("_row", "reply", F.col("above").alias("thread"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        state = cut(state.filter("done").unionByName(moved), "replies")
    return state.drop("done")


def conversations(table: DataFrame, unplaced: bool = False) -> DataFrame:
    """``conv_id, turn, part, role, text, reply_to, reply_part, quoted_turns, thread, thread_part, depth`` of every message, quotes removed.

    ``thread`` is the message a chain of replies begins with, ``depth`` the number of replies below it; ordered by
    (conv_id, thread, thread_part, depth, turn, part) a conversation reads in reply order.  A null text is empty.
    Rows with one (conversation, turn) are messages of their own, numbered by ``part`` in a hashed order of their
    role and text; none of them is earlier than another, and where one of several is answered it is the last that
    fits.  With ``unplaced``, rows with a null conversation or turn are kept, each alone: they answer nothing and nothing
    answers them.  Other columns are not read.
    """
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = table.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    if not unplaced:
        rows = rows.filter(placed)
    tie = F.pmod(F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), F.lit(1 << 20))
    messages = cut(split_lines(rows.withColumn("_tie", tie).withColumn("_row", F.monotonically_increasing_id())), "messages")
    known = messages.filter(placed)
    found = cut(links(known), "quotes")
    quotes = found.groupBy("_row").agg(F.max(F.when(F.col("level") == 1, F.struct("chars", "original")))["original"].alias("quoted"), F.array_sort(F.collect_set("original.turn")).alias("quoted_turns"))
    spot = F.struct("turn", "_tie", "_row")
    latest = known.groupBy("conv_id", "turn").agg(F.max(spot).alias("at"))
    before = previous_row(latest, "conv_id", ["turn"], ["at"], width=TURNS).select("conv_id", "turn", F.col("prev.at").alias("before"))
    linked = known.select(*KEYS, spot.alias("at")).join(before, ["conv_id", "turn"]).join(quotes.select("_row", "quoted"), "_row", "left")
    state = threads(linked.select("_row", "at", F.coalesce("quoted", "before").alias("reply")))
    shared = ordered_position(known.select(*KEYS), ["conv_id", "turn"], "_tie", ["_tie", "_row"], out="part", width=1 << 12)
    parts = cut(shared.filter("part > 0").select("_row", "part"), "parts")  # few: every other message is number 0
    numbered = lambda df, row, name: df.join(parts.select(F.col("_row").alias("_of"), F.col("part").alias(name)), F.col(row) == F.col("_of"), "left").drop("_of")
    state = numbered(numbered(numbered(state, "_row", "part"), "reply._row", "reply_part"), "thread._row", "thread_part")
    own = F.filter("_lines", lambda x: x["level"] == 0)
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"\n{3,}", "\n\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    out = messages.select("_row", "conv_id", "turn", "role", text.alias("text")).join(state, "_row", "left").join(quotes.select("_row", "quoted_turns"), "_row", "left")
    number = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return out.select(
        "conv_id", "turn", number("part"), "role", "text", F.col("reply.turn").alias("reply_to"), F.when(F.col("reply").isNotNull(), F.coalesce("reply_part", F.lit(0).cast("long"))).alias("reply_part"),
        F.coalesce("quoted_turns", F.array().cast("array<bigint>")).alias("quoted_turns"), F.coalesce("thread.turn", "turn").alias("thread"), number("thread_part"), number("depth"),
    )
