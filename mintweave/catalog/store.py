"""Stored tables, watches, exports and scalar functions over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.catalog.registry import query
from mintweave.catalog.tape import AS_OF, DAY, r6
from mintweave.functions import scalars as S
from mintweave.operators import graph as G
from mintweave.operators import store as D
from mintweave.operators import tape as T
from mintweave.operators import versions as V
from mintweave.session import shared_folder
from mintweave.sources import bindings as B


@query("upsert_by_key", "tape_l", sql="""
SELECT signature, wallet, mint, is_buy, block_time, quote_amount FROM (SELECT *, row_number() OVER (PARTITION BY signature, wallet, mint, is_buy ORDER BY block_time DESC, quote_amount DESC) AS r FROM tape) WHERE r = 1""")
def _(spark, sf):
    tape = B.tape_l(spark, sf).select("signature", "wallet", "mint", "is_buy", "block_time", "quote_amount")
    return D.upsert_by_key(tape.filter("is_buy"), tape.filter("not is_buy"), D.KEYS["trades"], "block_time")


def stored(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("stored_trades", "tape_l", sql="""
SELECT signature, wallet, mint, is_buy, block_time, quote_amount FROM (SELECT *, row_number() OVER (PARTITION BY signature, wallet, mint, is_buy ORDER BY block_time DESC, quote_amount DESC) AS r FROM tape) WHERE r = 1""")
def _(spark, sf):
    """Trades stored by two runs, one of them repeated, and read back."""
    tape, path = B.tape_l(spark, sf).select("signature", "wallet", "mint", "is_buy", "block_time", "quote_amount"), stored(spark, "trades")
    for run, part in (("one", tape.filter("is_buy")), ("two", tape), ("two", tape)):
        V.upsert_version(spark, path, part, D.KEYS["trades"], "block_time", run, buckets=8)
    return V.read_version(spark, path, ", ".join(f"{n} {k}" for n, k in tape.dtypes))


@query("stored_history", "tape_l", sql="SELECT wallet, mint, CASE WHEN bool_or(is_buy) THEN 'buy' ELSE 'sell' END AS side FROM tape GROUP BY ALL")
def _(spark, sf):
    """The launches of every wallet: buyers are stored first, sellers after them where they are new."""
    tape, path = B.tape_l(spark, sf), stored(spark, "history")
    for side, rule in (("buy", "is_buy"), ("sell", "not is_buy")):
        V.insert_version(spark, path, tape.filter(rule).select("wallet", "mint", F.lit(side).alias("side")), D.KEYS["wallet_launch_history"], side, buckets=8)
    return V.read_version(spark, path, "wallet long, mint long, side string")


@query("insert_new", "tape_l", sql="SELECT DISTINCT wallet, mint FROM tape WHERE NOT is_buy EXCEPT SELECT wallet, mint FROM tape WHERE is_buy")
def _(spark, sf):
    tape = B.tape_l(spark, sf).select("wallet", "mint", "is_buy")
    return D.insert_new(tape.filter("is_buy"), tape.filter("not is_buy"), D.KEYS["wallet_launch_history"]).select("wallet", "mint")


@query("replace_clusters", "tape_l", sql="""
WITH n AS (SELECT mint, wallet, 'new' AS origin FROM tape WHERE mayhem), o AS (SELECT mint, wallet, 'old' AS origin FROM tape WHERE NOT mayhem)
SELECT mint, wallet, origin, count(*) AS n FROM (SELECT * FROM n UNION ALL SELECT * FROM o WHERE mint NOT IN (SELECT mint FROM n)) GROUP BY ALL""")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    old = tape.filter("not mayhem").select("mint", "wallet", F.lit("old").alias("origin"))
    new = tape.filter("mayhem").select("mint", "wallet", F.lit("new").alias("origin"))
    return D.replace_clusters(old, new).groupBy("mint", "wallet", "origin").agg(F.count(F.lit(1)).alias("n"))


def scores(spark, sf):
    """A score log: one scan per trade, scores from the trade's fields."""
    tape = B.tape_l(spark, sf)
    score = (F.col("signature") * 7 + F.col("wallet") * 13 + F.col("leg")) % 101
    return tape.groupBy("mint", F.col("block_time").alias("created_at")).agg(F.max(score).cast("int").alias("score"), F.max("leg").alias("leg"))


SCORES = "scores AS (SELECT mint, block_time AS created_at, max((signature * 7 + wallet * 13 + leg) % 101)::INT AS score, max(leg) AS leg FROM tape GROUP BY ALL)"


@query("recent_scores", "tape_l", sql=f"WITH {SCORES} SELECT mint, created_at, score, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY created_at DESC) AS position FROM scores) WHERE position <= 5")
def _(spark, sf):
    return D.recent_scores(scores(spark, sf)).drop("leg")


@query("score_delta", "tape_l", sql=f"WITH {SCORES} SELECT mint, created_at, score, lag(score) OVER w AS previous_score, score - lag(score) OVER w AS delta FROM scores WINDOW w AS (PARTITION BY mint ORDER BY created_at)")
def _(spark, sf):
    return D.score_delta(scores(spark, sf), width=180 * DAY).drop("leg")


@query("append_scores", sql="""
SELECT l_partkey AS mint, 946684800::BIGINT AS created_at, max(l_linenumber * 10)::INT AS score, greatest(max(l_linenumber * 7), max(l_linenumber * 9))::INT AS coordination FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    n = F.max("l_linenumber")
    risk = B.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("mint")).agg(
        (n * 10).alias("bundle_score"), (n * 7).alias("funding_coordination"), (n * 9).alias("buy_coordination"), n.alias("confidence"), n.alias("overall_risk"))
    return D.score_rows(risk.withColumn("classification", F.lit("")), F.lit(AS_OF).cast("long")).select("mint", "created_at", "score", "coordination")


@query("stored_scores", "tape_l", sql=f"WITH {SCORES} SELECT mint, created_at, score FROM scores")
def _(spark, sf):
    """The score log as two appends, the second one repeated."""
    log, path = scores(spark, sf).select("mint", "created_at", "score"), stored(spark, "scores")
    for run, rule in (("even", "score % 2 = 0"), ("odd", "score % 2 = 1"), ("odd", "score % 2 = 1")):
        V.write_version(spark, path, log.filter(rule), ["mint"], run, buckets=8)
    return V.read_version(spark, path, ", ".join(f"{n} {k}" for n, k in log.dtypes))


@query("watch_alerts", "tape_l", sql=f"""WITH {SCORES},
w AS (SELECT mint AS watch, created_at, score, leg >= 5 AS g, score >= 60 AS x, lag(score) OVER o AS ps, lag(leg >= 5) OVER o AS pg, lag(score >= 60) OVER o AS px FROM scores WINDOW o AS (PARTITION BY mint ORDER BY created_at))
SELECT watch, created_at, coalesce(ps, 0) AS previous_score, score, concat_ws('; ', CASE WHEN abs(score - coalesce(ps, 0)) >= 8 THEN 'score moved' END, CASE WHEN g AND NOT coalesce(pg, FALSE) THEN 'graduated' END,
 CASE WHEN x AND NOT coalesce(px, FALSE) THEN 'coordinated selling' END) AS reason FROM w WHERE reason <> ''""")
def _(spark, sf):
    rows = scores(spark, sf).select(F.col("mint").alias("watch"), "created_at", "score", (F.col("leg") >= 5).alias("graduated"), F.col("score").alias("sell_score"))
    return D.watch_alerts(rows, width=180 * DAY)


@query("known_fingerprints", "tape_l", sql="SELECT mint, max(block_time) AS created_at, sha256(mint::VARCHAR) AS members_hash FROM tape WHERE mint NOT IN (SELECT mint FROM tape WHERE leg = 7 AND is_buy) GROUP BY mint")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    stored = tape.groupBy("mint").agg(F.max("block_time").alias("created_at")).withColumn("members_hash", F.sha2(F.col("mint").cast("string"), 256))
    return D.known_fingerprints(stored, tape.filter("leg = 7 and is_buy")).select("mint", "created_at", "members_hash")


@query("wallet_launches", "tape_l", sql="SELECT DISTINCT wallet, mint FROM tape")
def _(spark, sf):
    return D.wallet_launches(B.tape_l(spark, sf))


@query("creator_launches", "launches", sql="SELECT DISTINCT creator, mint FROM launches")
def _(spark, sf):
    return D.creator_launches(B.launches(spark, sf))


@query("scan_runs", sql="""
SELECT l_orderkey AS run_id, o_custkey AS mint, 'full' AS depth, date_diff('day', DATE '1970-01-01', min(l_shipdate)::DATE) * 86400 AS started_at,
 arg_max(l_linestatus, (l_shipdate, l_linestatus)) AS status, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE) * 86400 AS duration FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, sf):
    log = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("run_id"), F.col("o_custkey").alias("mint"), F.lit("full").alias("depth"), B.day_epoch(F.col("l_shipdate")).alias("at"),
        F.col("l_linestatus").alias("status"), F.lit("").alias("error"))
    return D.scan_runs(log).drop("error")


@query("store_stats", sql="""
SELECT 'creators' AS stored_table, count(*) AS rows FROM supplier UNION ALL SELECT 'launches', count(*) FROM part UNION ALL SELECT 'trades', count(*) FROM lineitem
UNION ALL SELECT 'scans', count(*) FROM orders UNION ALL SELECT 'wallets', count(*) FROM customer""")
def _(spark, sf):
    names = {"creators": "supplier", "launches": "part", "trades": "lineitem", "scans": "orders", "wallets": "customer"}
    return D.store_stats({k: B.table(spark, sf, v) for k, v in names.items()})


def user_events(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("wallet"), F.get_json_object("props", "$.k").cast("long").alias("mint"), "event_type", B.epoch(F.col("ts")).alias("at"), "value")


EVENTS = "ev AS (SELECT event_id, user_id AS wallet, json_extract_string(props, '$.k')::BIGINT AS mint, event_type, epoch(ts)::BIGINT AS t_at, value FROM (SELECT *, ts FROM (SELECT event_id, user_id, props, event_type, value, date_trunc('second', ts) AS ts FROM events)))"


@query("watch_registry", sql=f"""WITH {EVENTS}
SELECT mint, channel, added_at, changed_at FROM (SELECT mint, wallet % 5 AS channel, min(t_at) AS added_at, max(t_at) AS changed_at, arg_max(event_type <> 'error', (t_at, event_type <> 'error')) AS active FROM ev GROUP BY ALL) WHERE active""")
def _(spark, sf):
    log = user_events(spark, sf).select("mint", (F.col("wallet") % 5).alias("channel"), "at", (F.col("event_type") != "error").alias("active"))
    return D.watch_registry(log)


_TTL_SQL = "CASE " + " ".join(f"WHEN starts_with(key, '{k}') THEN {v}" for k, v in P.TTL_BY_PREFIX.items()) + f" ELSE {P.TTL_DEFAULT} END"
_NAMES = [*P.TTL_BY_PREFIX, "other"]


@query("expire_by_ttl", sql=f"""WITH {EVENTS}, k AS (SELECT event_id, ['{"', '".join(_NAMES)}'][(event_id % {len(_NAMES)} + 1)::INT] || ':' || wallet AS key, t_at AS stored_at FROM ev)
SELECT event_id, key, stored_at FROM k WHERE stored_at > 1706000000 - {_TTL_SQL}""")
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in _NAMES])
    key = F.concat(F.element_at(names, (F.col("event_id") % len(_NAMES) + 1).cast("int")), F.lit(":"), F.col("wallet").cast("string"))
    return D.expire_by_ttl(user_events(spark, sf).select("event_id", key.alias("key"), F.col("at").alias("stored_at")), 1706000000)


# --- scalar functions ----------------------------------------------------------------------------------


@query("clamp_and_scale", sql="SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_quantity / 40)) * 100, 0)::INT AS scaled FROM lineitem")
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return B.table(spark, sf, "lineitem").select(*keys, S.scale_to_100(F.col("l_quantity") / 40).alias("scaled"))


@query("logistic_confidence", sql="SELECT p_partkey, round(1.0::DOUBLE / (1 + exp(-0.35::DOUBLE * (p_size - 12.5::DOUBLE))), 6) AS confidence FROM part")
def _(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.round(S.logistic_confidence(F.col("p_size"), 12.5), 6).alias("confidence"))


@query("similarity_from_cv", sql="""SELECT p_partkey, round(CASE WHEN cv <= 0.02::DOUBLE THEN 1 WHEN cv >= 0.6::DOUBLE THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * ((cv - 0.02::DOUBLE) / (0.6::DOUBLE - 0.02::DOUBLE)))) END, 6) AS similarity
FROM (SELECT p_partkey, p_size / 70.0::DOUBLE AS cv FROM part)""")
def _(spark, sf):
    return B.table(spark, sf, "part").select("p_partkey", F.round(S.similarity_from_cv(F.col("p_size") / 70.0), 6).alias("similarity"))


@query("timing_similarity", "tape_l", sql="""SELECT mint, wallet, round(CASE WHEN count(*) < 2 THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (max(block_time) - min(block_time)) / 86400000.0::DOUBLE))) END, 6) AS similarity FROM tape GROUP BY ALL""")
def _(spark, sf):
    return B.tape_l(spark, sf).groupBy("mint", "wallet").agg(F.round(S.timing_similarity(F.col("block_time"), 86400000), 6).alias("similarity"))


@query("amount_similarity", "tape_l", sql="""SELECT mint, round(CASE WHEN count(*) < 2 THEN 0 WHEN cv <= 0.02::DOUBLE THEN 1 WHEN cv >= 0.6::DOUBLE THEN 0 ELSE 0.5::DOUBLE * (1 + cos(pi() * ((cv - 0.02::DOUBLE) / (0.6::DOUBLE - 0.02::DOUBLE)))) END, 6) AS similarity
FROM (SELECT mint, count(*) AS n, stddev_pop(quote_amount) / avg(quote_amount) AS cv FROM tape GROUP BY ALL) GROUP BY mint, cv, n""".replace("count(*) < 2", "n < 2"))
def _(spark, sf):
    return B.tape_l(spark, sf).groupBy("mint").agg(F.round(S.amount_similarity(F.col("quote_amount")), 6).alias("similarity"))


@query("set_similarity", "tape_l", sql="""
WITH s AS (SELECT mint, list(DISTINCT wallet) FILTER (WHERE is_buy) AS b, list(DISTINCT wallet) FILTER (WHERE NOT is_buy) AS s FROM tape GROUP BY ALL)
SELECT mint, round(CASE WHEN b IS NULL OR s IS NULL THEN 0 ELSE len(list_intersect(b, s)) / len(list_distinct(list_concat(b, s)))::DOUBLE END, 6) AS jaccard,
 round(CASE WHEN b IS NULL OR s IS NULL THEN 0 ELSE len(list_intersect(b, s)) / least(len(b), len(s))::DOUBLE END, 6) AS overlap_coefficient FROM s""")
def _(spark, sf):
    # Counts per (mint, wallet) instead of wallet sets: a launch may have any number of wallets.
    side = B.tape_l(spark, sf).groupBy("mint", "wallet").agg(F.max(F.col("is_buy").cast("int")).alias("b"), F.max((~F.col("is_buy")).cast("int")).alias("s"))
    n = side.groupBy("mint").agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum(F.col("b") * F.col("s")).alias("both"), F.count(F.lit(1)).alias("any"))
    empty = (F.col("b") == 0) | (F.col("s") == 0)
    return n.select(
        "mint", F.round(F.when(empty, 0.0).otherwise(F.col("both") / F.col("any")), 6).alias("jaccard"),
        F.round(F.when(empty, 0.0).otherwise(F.col("both") / F.least("b", "s")), 6).alias("overlap_coefficient"),
    )


@query("normalized_entropy", "tape_b", sql="""
WITH c AS (SELECT mint, wallet, count(*)::DOUBLE AS n FROM tape GROUP BY ALL), t AS (SELECT mint, sum(n) AS t, count(*) AS k FROM c GROUP BY ALL)
SELECT mint, round(CASE WHEN k < 2 THEN 0 ELSE -sum(n / t * ln(n / t)) / ln(k) END, 6) AS entropy FROM c JOIN t USING (mint) GROUP BY mint, k""")
def _(spark, sf):
    # Grouped sums, not one array per launch: H = ln(T) - sum(n ln n) / T.
    counts = B.tape_b(spark, sf).groupBy("mint", "wallet").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.groupBy("mint").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("x"), F.count(F.lit(1)).alias("k"))
    h = (F.ln("t") - F.col("x") / F.col("t")) / F.ln("k")
    return sums.select("mint", F.round(F.when(F.col("k") < 2, 0.0).otherwise(h), 6).alias("entropy"))


@query("shorten", sql="SELECT s_suppkey, CASE WHEN length(s_name) <= 9 THEN s_name ELSE left(s_name, 4) || '…' || right(s_name, 4) END AS short FROM supplier")
def _(spark, sf):
    return B.table(spark, sf, "supplier").select("s_suppkey", S.shorten(F.col("s_name")).alias("short"))


@query("human_duration", sql="""
SELECT event_id, CASE WHEN v < 1 THEN round_even(v * 1000, 0)::BIGINT || 'ms' WHEN v < 60 THEN round_even(v, 0)::BIGINT || 's' WHEN w // 60 < 60 THEN (w // 60) || 'm ' || (w % 60) || 's'
 WHEN w // 3600 < 24 THEN (w // 3600) || 'h ' || (w // 60 % 60) || 'm' ELSE (w // 86400) || 'd ' || (w // 3600 % 24) || 'h' END AS duration
FROM (SELECT event_id, x AS v, floor(x)::BIGINT AS w FROM (SELECT event_id, value * value * value / 4 AS x FROM events))""")
def _(spark, sf):
    v = F.col("value")
    return B.table(spark, sf, "events").select("event_id", S.human_duration(v * v * v / 4).alias("duration"))


@query("human_age", "launches", sql=f"SELECT mint, (d // 86400) || 'd ' || (d // 3600 % 24) || 'h' AS age FROM (SELECT mint, {AS_OF} + 7200 - created_at AS d FROM launches)")
def _(spark, sf):
    return B.launches(spark, sf).select("mint", S.human_age(F.col("created_at"), F.lit(AS_OF + 7200)).alias("age"))


@query("from_unix", "launches", sql="SELECT mint, CASE WHEN mint % 5 = 0 THEN NULL ELSE strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M:%S') END AS created FROM launches")
def _(spark, sf):
    odd = F.when(F.col("mint") % 5 == 0, F.lit(10**15)).otherwise(F.col("created_at"))
    days = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(S.from_unix(odd)) / 86400).cast("int"))
    return B.launches(spark, sf).select("mint", F.when(S.from_unix(odd).isNotNull(), F.concat(days.cast("string"), F.lit(" 00:00:00"))).alias("created"))


@query("launch_age", "launches", sql="SELECT mint, greatest(0, 820454400 - created_at)::DOUBLE AS age_seconds FROM launches")
def _(spark, sf):
    return B.launches(spark, sf).select("mint", S.launch_age(F.col("created_at"), F.lit(820454400)).alias("age_seconds"))


@query("resolve_pair", "launches", sql="""
SELECT mint, CASE WHEN quote_mint IS NULL OR quote_mint LIKE 'So1%' THEN 'SOL' WHEN quote_mint LIKE 'EPj%' THEN 'USDC' ELSE 'UNKNOWN' END AS pair, (CASE WHEN quote_mint LIKE 'EPj%' THEN 6 ELSE 9 END)::INT AS decimals,
 round(real_token_reserves / (CASE WHEN quote_mint LIKE 'EPj%' THEN 1e6 ELSE 1e9 END)::DOUBLE, 6) AS ui_amount FROM launches""")
def _(spark, sf):
    d = S.quote_decimals(F.col("quote_mint"))
    return B.launches(spark, sf).select("mint", S.resolve_pair(F.col("quote_mint")).alias("pair"), d.alias("decimals"), F.round(S.ui_amount(F.col("real_token_reserves"), d), 6).alias("ui_amount"))


@query("graduation_progress", "launches", sql="SELECT mint, round(CASE WHEN curve_complete THEN 1 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - real_token_reserves / initial_real_tokens::DOUBLE)) END, 6) AS progress FROM launches")
def _(spark, sf):
    p = S.graduation_progress(F.col("curve_complete"), F.col("real_token_reserves"), F.col("initial_real_tokens"))
    return B.launches(spark, sf).select("mint", F.round(p, 6).alias("progress"))


@query("members_hash", "tape_l", sql="SELECT mint, substr(sha256(array_to_string(list_sort(list(DISTINCT wallet::VARCHAR)), '|')), 1, 16) AS members_hash FROM tape WHERE is_buy GROUP BY mint")
def _(spark, sf):
    early = T.first_buyers(B.tape_l(spark, sf), None)
    return early.groupBy("mint").agg(S.members_hash(F.collect_set(F.col("wallet").cast("string"))).alias("members_hash"))


@query("text_maps", sql="""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '🟢' WHEN 1 THEN '🟡' WHEN 2 THEN '🟠' ELSE '🔴' END AS emoji,
 CASE p_size % 5 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'BONDING CURVE' WHEN 2 THEN 'NEAR GRADUATION' WHEN 3 THEN 'GRADUATED' ELSE 'GRADUATED → PUMPSWAP' END AS lifecycle FROM part""")
def _(spark, sf):
    level = F.element_at(F.array(*[F.lit(x) for x in S.RISK_EMOJI]), F.col("p_size") % 4 + 1)
    state = F.element_at(F.array(*[F.lit(x) for x in S.LIFECYCLE_LABELS]), F.col("p_size") % 5 + 1)
    return B.table(spark, sf, "part").select("p_partkey", S.text_of(level, S.RISK_EMOJI).alias("emoji"), S.text_of(state, S.LIFECYCLE_LABELS).alias("lifecycle"))
