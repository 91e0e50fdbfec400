"""Tape, windows, early buyers, execution links."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.catalog.registry import query
from mintweave.functions import scalars as S
from mintweave.operators import execution as X
from mintweave.operators import tape as T
from mintweave.sources import bindings as B

DAY = B.DAY
AS_OF = 946684800  # 2000-01-01
RANKED = "row_number() OVER (PARTITION BY mint ORDER BY {o}) AS position".format(o=B.ORDER_SQL)
EARLY = "early AS (SELECT *, {r} FROM tape WHERE is_buy)".format(r=RANKED)
FIRST = "first_buys AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mint, wallet ORDER BY {o}) AS _r FROM tape WHERE is_buy) WHERE _r = 1)".format(o=B.ORDER_SQL)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("trade_index", "tape_l", sql="""
SELECT mint, wallet, signature, leg, quote_amount,
 row_number() OVER (PARTITION BY mint ORDER BY block_time, slot, signature, leg, wallet, token_amount, quote_amount) - 1 AS trade_index FROM tape""")
def _(spark, sf):
    return T.trade_index(B.tape_l(spark, sf)).select("mint", "wallet", "signature", "leg", "quote_amount", "trade_index")


@query("trade_index_hot_launch", "tape_b", sql="""
SELECT mint, wallet, signature, leg, part, quote_amount,
 row_number() OVER (PARTITION BY mint ORDER BY block_time, slot, signature, leg, wallet, token_amount, quote_amount) - 1 AS trade_index FROM tape""")
def _(spark, sf):
    return T.trade_index(B.tape_b(spark, sf)).select("mint", "wallet", "signature", "leg", "part", "quote_amount", "trade_index")


@query("seconds_after_launch", "tape_l", "launches", sql="""
SELECT mint, wallet, signature, leg, greatest(0, block_time - created_at)::DOUBLE AS seconds_after_launch
FROM tape LEFT JOIN launches USING (mint)""")
def _(spark, sf):
    return T.with_seconds(B.tape_l(spark, sf), B.launches(spark, sf)).select("mint", "wallet", "signature", "leg", "seconds_after_launch")


@query("tape_filters", "tape_l", sql="""
SELECT mint, wallet, count(*) FILTER (WHERE is_buy) AS buys, count(*) FILTER (WHERE NOT is_buy) AS sells,
 count(*) FILTER (WHERE NOT tx_success) AS failed FROM tape GROUP BY ALL""")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    return tape.groupBy("mint", "wallet").agg(
        F.count(F.when(F.col("is_buy"), 1)).alias("buys"),
        F.count(F.when(~F.col("is_buy"), 1)).alias("sells"),
        F.count(F.when(~F.col("tx_success"), 1)).alias("failed"),
    )


@query("implied_price", "tape_l", sql="""
SELECT mint, wallet, signature, leg, round(CASE WHEN token_amount > 0 THEN quote_amount / token_amount END, 8) AS implied_price FROM tape""")
def _(spark, sf):
    price = S.implied_price(F.col("quote_amount"), F.col("token_amount"))
    return B.tape_l(spark, sf).select("mint", "wallet", "signature", "leg", F.round(price, 8).alias("implied_price"))


@query("token_position", "tape_l", sql="""
SELECT mint, wallet, round(sum(CASE WHEN is_buy THEN token_amount ELSE -token_amount END), 6) AS token_position FROM tape GROUP BY ALL""")
def _(spark, sf):
    return T.token_position(B.tape_l(spark, sf)).select("mint", "wallet", *r6("token_position"))


@query("first_buys", "tape_l", sql=f"WITH {FIRST} SELECT mint, wallet, signature, block_time, slot, quote_amount, token_amount FROM first_buys")
def _(spark, sf):
    return T.first_buys(B.tape_l(spark, sf)).select("mint", "wallet", "signature", "block_time", "slot", "quote_amount", "token_amount")


@query("first_buyers", "tape_b", sql=f"""WITH {FIRST}
SELECT * FROM (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL})::INT AS position FROM first_buys) WHERE position <= 50""")
def _(spark, sf):
    return T.first_buyers(B.tape_b(spark, sf), 50).select("mint", "wallet", "position")


@query("early_share", "tape_b", sql=f"WITH {EARLY} SELECT mint, wallet, signature, leg, part, position::INT AS position FROM early WHERE position <= 100")
def _(spark, sf):
    return T.early_buys(B.tape_b(spark, sf), 100).select("mint", "wallet", "signature", "leg", "part", "position")


def _window_sql(names):
    cols = ", ".join(f"count(*) FILTER (WHERE s <= {limit}) AS {name}" for name, limit in names.items())
    return f"""SELECT mint, {cols} FROM (SELECT mint, wallet, min(greatest(0, block_time - created_at)) AS s
 FROM tape JOIN launches USING (mint) WHERE is_buy GROUP BY ALL) GROUP BY mint"""


DAY_WINDOWS = {name: days * DAY for name, days in P.WINDOWS.items()}


@query("window_counts", "tape_l", "launches", sql=_window_sql(DAY_WINDOWS))
def _(spark, sf):
    return T.window_counts(B.tape_l(spark, sf), B.launches(spark, sf), DAY_WINDOWS)


@query("timeline_counts", "tape_l", "launches", sql=_window_sql({f"t{c}": c * DAY for c in P.CHECKPOINTS}))
def _(spark, sf):
    return T.timeline_counts(B.tape_l(spark, sf), B.launches(spark, sf), unit=DAY)


def _describe_sql(value, keys, source):
    return f"""SELECT {keys}, count({value}) AS n, round(coalesce(avg({value}), 0), 6) AS mean, round(coalesce(stddev_pop({value}), 0), 6) AS stdev,
 round(coalesce(CASE WHEN avg({value}) <> 0 THEN stddev_pop({value}) / abs(avg({value})) ELSE 0 END, 0), 6) AS cv,
 coalesce(min({value}), 0) AS minimum, coalesce(max({value}), 0) AS maximum, round(coalesce(max({value}) - min({value}), 0), 6) AS spread,
 round(coalesce(quantile_cont({value}, 0.25::DOUBLE), 0), 6) AS p25, round(coalesce(quantile_cont({value}, 0.5::DOUBLE), 0), 6) AS median,
 round(coalesce(quantile_cont({value}, 0.75::DOUBLE), 0), 6) AS p75, round(coalesce(quantile_cont({value}, 0.9::DOUBLE), 0), 6) AS p90
FROM {source} GROUP BY ALL"""


DESCRIBED = ("mean", "stdev", "cv", "spread", "p25", "median", "p75", "p90")


@query("describe_distribution", "tape_b", sql=_describe_sql("quote_amount", "mint", "tape"))
def _(spark, sf):
    out = T.describe_distribution(B.tape_b(spark, sf), ["mint"], "quote_amount")
    return out.select("mint", "n", "minimum", "maximum", *r6(*DESCRIBED))


@query("purchase_distribution", "tape_l", sql=f"WITH {EARLY} " + _describe_sql("quote_amount", "mint", "(SELECT * FROM early WHERE position <= 20 AND quote_amount > 0)"))
def _(spark, sf):
    return T.purchase_distribution(B.tape_l(spark, sf), 20).select("mint", "n", "minimum", "maximum", *r6(*DESCRIBED))


@query("buy_intervals", "tape_b", sql=f"""WITH {EARLY}
SELECT mint, position::INT AS position, wallet, block_time, slot, block_time - lag(block_time) OVER w AS interval_seconds,
 CASE WHEN slot > lag(slot) OVER w THEN slot - lag(slot) OVER w END AS slot_gap
FROM early WHERE position <= 30 WINDOW w AS (PARTITION BY mint ORDER BY position)""")
def _(spark, sf):
    return T.buy_intervals(B.tape_b(spark, sf), 30)


@query("slot_analysis", "tape_l", sql=f"""WITH {EARLY},
cut AS (SELECT *, block_time - lag(block_time) OVER (PARTITION BY mint ORDER BY position) AS gap_t FROM early WHERE position <= 30),
slots AS (SELECT mint, slot, count(*) AS n, count(DISTINCT wallet) AS w FROM cut GROUP BY ALL),
gaps AS (SELECT *, slot - lag(slot) OVER (PARTITION BY mint ORDER BY slot) AS gap FROM slots),
sharing AS (SELECT cut.mint, count(DISTINCT wallet) AS k FROM cut JOIN slots ON slots.mint = cut.mint AND slots.slot = cut.slot WHERE w > 1 GROUP BY ALL)
SELECT mint, sum(n)::BIGINT AS buys_considered, count(*) AS distinct_slots,
 array_to_string(list_sort(list(slot))[1:20], ',') AS slots,
 count(*) FILTER (WHERE w > 1) AS shared_slots, coalesce(any_value(k), 0) AS wallets_sharing_a_slot,
 count(*) FILTER (WHERE gap = 1) AS adjacent_slot_pairs, round(median(gap), 6) AS median_slot_gap,
 round(any_value(mi), 6) AS median_interval_seconds
FROM gaps LEFT JOIN sharing USING (mint) LEFT JOIN (SELECT mint, median(gap_t) AS mi FROM cut GROUP BY ALL) USING (mint) GROUP BY mint""")
def _(spark, sf):
    out = T.slot_analysis(B.tape_l(spark, sf), 30)
    return out.withColumn("slots", F.array_join("slots", ",")).withColumn("median_slot_gap", F.round("median_slot_gap", 6)).withColumn(
        "median_interval_seconds", F.round("median_interval_seconds", 6)
    )


@query("shared_slots", "tape_b", sql=f"""WITH {EARLY}
SELECT mint, slot, array_to_string(list_sort(list(DISTINCT wallet)), ',') AS wallets FROM early WHERE position <= 30 GROUP BY ALL HAVING count(DISTINCT wallet) > 1""")
def _(spark, sf):
    return T.shared_slot_wallets(B.tape_b(spark, sf), 30).withColumn("wallets", F.array_join("wallets", ","))


@query("transaction_order", "tape_l", sql=f"""WITH {EARLY},
tx AS (SELECT l_orderkey AS signature, count(*) AS account_count, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS programs FROM lineitem GROUP BY ALL)
SELECT mint, position::INT AS position, wallet, signature, slot, quote_amount, account_count::INT AS account_count, programs
FROM early LEFT JOIN tx USING (signature) WHERE position <= 20""")
def _(spark, sf):
    tx = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("signature")).agg(
        F.collect_list("l_linenumber").alias("account_keys"),
        F.collect_set("l_returnflag").alias("programs"),
        F.collect_set("l_linestatus").alias("instructions"),
    )
    out = T.transaction_order(B.tape_l(spark, sf), tx, 20)
    return out.select("mint", "position", "wallet", "signature", "slot", "quote_amount", "account_count", F.array_join("programs", ",").alias("programs"))


@query("execution_sponsors", "tape_b", sql=f"""WITH {EARLY}
SELECT mint, fee_payer, count(DISTINCT wallet) AS wallets, count(*) AS sponsored_buys, min(signature) AS first_signature
FROM early WHERE fee_payer <> wallet GROUP BY ALL HAVING count(DISTINCT wallet) >= 2""")
def _(spark, sf):
    return X.execution_sponsors(B.tape_b(spark, sf), None)


@query("sponsor_signatures", "tape_b", sql=f"""WITH {EARLY}, s AS (SELECT * FROM early WHERE fee_payer <> wallet AND position <= 100)
SELECT DISTINCT mint, fee_payer, signature, wallet FROM s
WHERE (mint, fee_payer) IN (SELECT (mint, fee_payer) FROM s GROUP BY mint, fee_payer HAVING count(DISTINCT wallet) >= 2)""")
def _(spark, sf):
    return X.sponsor_signatures(B.tape_b(spark, sf), 100)


@query("execution_atomic_groups", "tape_b", sql=f"""WITH {EARLY}
SELECT mint, signature, count(DISTINCT wallet) AS wallets, min(wallet) AS first_wallet, max(wallet) AS last_wallet
FROM early GROUP BY ALL HAVING count(DISTINCT wallet) >= 2""")
def _(spark, sf):
    return X.execution_atomic_groups(B.tape_b(spark, sf), None)


@query("linked_wallets", "tape_b", sql=f"""WITH {EARLY}, e AS (SELECT * FROM early WHERE position <= 100),
s AS (SELECT DISTINCT mint, fee_payer AS g, wallet FROM e WHERE fee_payer <> wallet),
a AS (SELECT DISTINCT mint, signature AS g, wallet FROM e)
SELECT mint, wallet FROM s WHERE (mint, g) IN (SELECT (mint, g) FROM s GROUP BY mint, g HAVING count(*) >= 2)
UNION SELECT mint, wallet FROM a WHERE (mint, g) IN (SELECT (mint, g) FROM a GROUP BY mint, g HAVING count(*) >= 2)""")
def _(spark, sf):
    return X.linked_wallets(B.tape_b(spark, sf), 100)


def slot_clusters(tape):
    """Stand-in clusters of any size for the measuring operators: wallets of a launch by month of first buy."""
    first = T.first_buys(tape)
    return first.select("mint", F.floor(F.col("slot") / 30).cast("long").alias("cluster_id"), "wallet", "block_time", "quote_amount")


CLUSTERS = f"{FIRST}, members AS (SELECT mint, floor(slot / 30)::BIGINT AS cluster_id, wallet, block_time, quote_amount FROM first_buys), sizes AS (SELECT mint, cluster_id, count(*) AS size FROM members GROUP BY ALL)"

GROUPS = """s AS (SELECT DISTINCT mint, fee_payer AS g, wallet FROM tape WHERE is_buy AND fee_payer <> wallet),
a AS (SELECT DISTINCT mint, signature AS g, wallet FROM tape WHERE is_buy),
sp AS (SELECT mint, cluster_id, g, count(*) AS k FROM members JOIN s USING (mint, wallet) GROUP BY ALL HAVING count(*) >= 2),
atx AS (SELECT mint, cluster_id, g, count(*) AS k FROM members JOIN a USING (mint, wallet) GROUP BY ALL HAVING count(*) >= 2)"""


@query("execution_strength", "tape_b", sql=f"""WITH {CLUSTERS}, {GROUPS}
SELECT mint, cluster_id, round(least(1.0::DOUBLE, greatest(coalesce((SELECT max(k) FROM sp WHERE sp.mint = z.mint AND sp.cluster_id = z.cluster_id), 0) / size::DOUBLE,
 1.25::DOUBLE * coalesce((SELECT max(k) FROM atx WHERE atx.mint = z.mint AND atx.cluster_id = z.cluster_id), 0) / size::DOUBLE)), 6) AS shared_signer FROM sizes z""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    out = X.execution_strength(slot_clusters(tape), X.sponsor_members(tape, None), X.atomic_members(tape, None))
    return out.select("mint", "cluster_id", *r6("shared_signer"))


@query("atomic_stats", "tape_b", sql=f"""WITH {CLUSTERS}, {GROUPS},
cover AS (SELECT m.mint, m.cluster_id, count(DISTINCT m.wallet) AS c FROM members m JOIN a ON a.mint = m.mint AND a.wallet = m.wallet
 JOIN atx ON atx.mint = m.mint AND atx.cluster_id = m.cluster_id AND atx.g = a.g GROUP BY ALL),
big AS (SELECT mint, cluster_id, max(k) AS k FROM atx GROUP BY ALL)
SELECT mint, cluster_id, coalesce(k, 0) AS atomic_size, round(coalesce(c, 0) / size::DOUBLE, 6) AS atomic_share
FROM sizes LEFT JOIN big USING (mint, cluster_id) LEFT JOIN cover USING (mint, cluster_id)""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    return X.atomic_stats(slot_clusters(tape), X.atomic_members(tape, None)).select("mint", "cluster_id", "atomic_size", *r6("atomic_share"))


@query("union_venues", "tape_l", sql="""
SELECT mint, count(*) AS trades, count(DISTINCT signature) AS transactions FROM (
 SELECT * FROM tape WHERE leg <= 3 UNION ALL
 SELECT * FROM tape t WHERE leg > 3 AND NOT EXISTS (SELECT 1 FROM tape c WHERE c.leg <= 3 AND c.mint = t.mint AND c.signature = t.signature)) GROUP BY ALL""")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    both = T.union_venues(tape.filter("leg <= 3"), tape.filter("leg > 3"))
    per_tx = both.groupBy("mint", "signature").agg(F.count(F.lit(1)).alias("_n"))
    return per_tx.groupBy("mint").agg(F.sum("_n").alias("trades"), F.count(F.lit(1)).alias("transactions"))


@query("dedupe_ordered", "tape_l", sql="SELECT mint, wallet, min(block_time) AS first_position FROM tape GROUP BY ALL")
def _(spark, sf):
    return T.dedupe_ordered(B.tape_l(spark, sf), ["mint"], "wallet", "block_time")


@query("shared_buyers", "tape_l", sql="SELECT wallet FROM tape WHERE is_buy AND mint = 1 INTERSECT SELECT wallet FROM tape WHERE is_buy AND mint = 2")
def _(spark, sf):
    return T.shared_buyers(B.tape_l(spark, sf), 1, 2)


@query("new_only", "tape_l", sql="SELECT DISTINCT mint, wallet FROM tape WHERE is_buy EXCEPT SELECT mint, wallet FROM tape WHERE NOT is_buy")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    return T.new_only(T.buys(tape).select("mint", "wallet").distinct(), T.sells(tape), ["mint", "wallet"])


@query("mayhem_separation", "tape_l", "launches", sql="""
WITH w AS (SELECT mint, wallet, count(*) AS n, count(*) FILTER (WHERE mayhem) AS f, bool_and(mayhem) AS every_one FROM tape GROUP BY ALL),
c AS (SELECT mint, is_mayhem, coalesce(sum(n), 0)::BIGINT AS trades, coalesce(sum(f), 0)::BIGINT AS flagged_trades,
 count(*) FILTER (WHERE every_one) AS automated_wallets, coalesce(sum(n) FILTER (WHERE every_one), 0)::BIGINT AS automated_trades
 FROM launches LEFT JOIN w USING (mint) GROUP BY ALL)
SELECT mint, is_mayhem OR flagged_trades > 0 AS enabled, trades, flagged_trades, automated_wallets, automated_trades, 0::BIGINT AS param_updates,
 trades - automated_trades AS human_trades,
 CASE WHEN NOT (is_mayhem OR flagged_trades > 0) THEN 0 WHEN trades = 0 THEN 50 ELSE round_even(100.0::DOUBLE * flagged_trades / trades, 0) END::INT AS activity FROM c""")
def _(spark, sf):
    return T.mayhem_separation(B.tape_l(spark, sf), B.launches(spark, sf))


@query("automated_wallets", "tape_l", sql="SELECT mint, wallet FROM tape GROUP BY ALL HAVING bool_and(mayhem)")
def _(spark, sf):
    return T.automated_wallets(B.tape_l(spark, sf))


STATES = "CASE {s} WHEN 'CREATED' THEN 'CREATED' WHEN 'BONDING_CURVE' THEN 'BONDING CURVE' WHEN 'NEAR_GRADUATION' THEN 'NEAR GRADUATION' WHEN 'GRADUATED' THEN 'GRADUATED' ELSE 'GRADUATED → PUMPSWAP' END"


@query("lifecycle_state", "tape_l", "launches", sql=f"""
WITH n AS (SELECT mint, count(*) AS trades FROM tape WHERE NOT is_buy GROUP BY ALL),
p AS (SELECT mint, coalesce(trades, 0) AS trades, pool, curve_complete,
 CASE WHEN curve_complete THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - real_token_reserves / initial_real_tokens::DOUBLE)) END AS progress,
 greatest(0, {AS_OF} - created_at)::DOUBLE AS age_seconds FROM launches LEFT JOIN n USING (mint)),
s AS (SELECT *, CASE WHEN curve_complete THEN CASE WHEN pool IS NOT NULL THEN 'PUMPSWAP' ELSE 'GRADUATED' END WHEN progress >= 0.8::DOUBLE THEN 'NEAR_GRADUATION'
 WHEN trades = 0 AND age_seconds < 60 THEN 'CREATED' ELSE 'BONDING_CURVE' END AS state FROM p)
SELECT mint, trades, round(progress, 6) AS progress, age_seconds, state,
 CASE state WHEN 'PUMPSWAP' THEN 'GRADUATED → PUMPSWAP' WHEN 'GRADUATED' THEN 'GRADUATED (PumpSwap pool not located yet)'
  ELSE {STATES.format(s='state')} || ' · graduation ' || round_even(progress * 100, 0)::BIGINT || '% complete' END AS state_text FROM s""")
def _(spark, sf):
    out = T.lifecycle(B.launches(spark, sf), T.sells(B.tape_l(spark, sf)), AS_OF)
    return out.withColumn("progress", F.round("progress", 6))
