"""Ages, histories, creators, holders, exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.catalog.funding import FUNDING, PATHS, paths
from mintweave.catalog.registry import query
from mintweave.catalog.tape import CLUSTERS, DAY, FIRST, r6, slot_clusters
from mintweave.functions import scalars as S
from mintweave.operators import creator as C
from mintweave.operators import entities as E
from mintweave.operators import funding as M
from mintweave.operators import history as H
from mintweave.operators import holders as O
from mintweave.operators import sells as X
from mintweave.operators import tape as T
from mintweave.operators import wallets as W
from mintweave.sources import bindings as B

TX = "block_time, slot, signature"


@query("latest_n_before", "wallet_tx", sql="""
WITH c AS (SELECT address, max(signature) AS signature FROM wallet_tx WHERE err IS NULL GROUP BY ALL),
m AS (SELECT w.address, w.block_time AS t, w.signature AS s FROM wallet_tx w JOIN c USING (address, signature))
SELECT address, signature, block_time, position::INT AS position FROM (SELECT w.*, row_number() OVER (PARTITION BY address ORDER BY block_time DESC, w.signature DESC) AS position
 FROM wallet_tx w JOIN m USING (address) WHERE (w.block_time, w.signature) < (t, s)) WHERE position <= 5""")
def _(spark, sf):
    tx = B.wallet_tx(spark, sf)
    cursors = tx.filter("err is null").groupBy("address").agg(F.max("signature").alias("signature"))
    return W.latest_n_before(tx, cursors, 5).select("address", "signature", "block_time", "position")


@query("newest_page", "wallet_tx", sql="""
SELECT address, signature, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_time DESC, signature DESC) AS position
 FROM wallet_tx WHERE block_time >= 800000000) WHERE position <= 4""")
def _(spark, sf):
    return W.newest_page(B.wallet_tx(spark, sf), 4, since=800000000).select("address", "signature", "position")


@query("oldest_activity", "wallet_tx", sql="""
SELECT address, block_time, slot, signature FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_time, signature) AS r FROM wallet_tx) WHERE r = 1""")
def _(spark, sf):
    return W.oldest_activity(B.wallet_tx(spark, sf))


@query("current_balances", "deltas", sql="""
SELECT address, round(arg_max(post, (block_time, signature)) / 1e9::DOUBLE, 6) AS balance FROM sol_deltas GROUP BY ALL""")
def _(spark, sf):
    return W.current_balances(B.sol_deltas(spark, sf)).select("address", *r6("balance"))


AGES = f"""{FIRST}, seen AS (SELECT address AS wallet, min(block_time) AS first_seen, count(*) AS signatures FROM wallet_tx GROUP BY ALL),
ages AS (SELECT mint, wallet, f.block_time, first_seen, coalesce(signatures, 0) AS signatures, greatest(0, block_time - first_seen)::DOUBLE AS age_seconds,
 coalesce(abs(block_time - first_seen) <= 1, FALSE) AS first_action FROM first_buys f LEFT JOIN seen USING (wallet))"""


@query("wallet_age", "tape_c", "wallet_tx", sql=f"WITH {AGES} SELECT mint, wallet, first_seen, signatures, FALSE AS age_bounded, age_seconds, first_action FROM ages")
def _(spark, sf):
    return W.wallet_age(T.first_buys(B.tape_c(spark, sf)), B.launches(spark, sf), B.wallet_tx(spark, sf))


@query("wallet_age_paged", "tape_c", "wallet_tx", sql=f"""WITH {FIRST},
page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_time DESC, signature DESC) AS r FROM wallet_tx) WHERE r <= 5),
seen AS (SELECT address AS wallet, min(block_time) AS first_seen, count(*) AS signatures FROM page GROUP BY ALL)
SELECT mint, wallet, first_seen, coalesce(signatures >= 5, FALSE) AS age_bounded, greatest(0, block_time - first_seen)::DOUBLE AS age_seconds FROM first_buys LEFT JOIN seen USING (wallet)""")
def _(spark, sf):
    out = W.wallet_age(T.first_buys(B.tape_c(spark, sf)), B.launches(spark, sf), B.wallet_tx(spark, sf), page_cap=5)
    return out.select("mint", "wallet", "first_seen", "age_bounded", "age_seconds")


FRESH = "CASE WHEN a IS NULL THEN 'unknown' " + " ".join(f"WHEN a < {b} THEN '{n}'" for n, b in P.FRESH_BUCKETS) + " ELSE '>24h' END"


@query("fresh_bucket", "tape_c", "wallet_tx", sql=f"WITH {AGES} SELECT mint, wallet, nullif({FRESH}, 'unknown') AS fresh_bucket FROM (SELECT *, age_seconds / 1440 AS a FROM ages)")
def _(spark, sf):
    ages = W.wallet_age(T.first_buys(B.tape_c(spark, sf)), B.launches(spark, sf), B.wallet_tx(spark, sf))
    return ages.select("mint", "wallet", S.fresh_bucket(F.col("age_seconds") / 1440).alias("fresh_bucket"))


@query("fresh_bucket_counts", "tape_c", "wallet_tx", sql=f"WITH {AGES}, b AS (SELECT mint, {FRESH} AS b FROM (SELECT mint, age_seconds / 1440 AS a FROM ages)) SELECT mint, "
       + ", ".join(f"""count(*) FILTER (WHERE b = '{n}') AS "{n}" """ for n in [*(n for n, _ in P.FRESH_BUCKETS), ">24h", "unknown"]) + " FROM b GROUP BY mint")
def _(spark, sf):
    ages = W.wallet_age(T.first_buys(B.tape_c(spark, sf)), B.launches(spark, sf), B.wallet_tx(spark, sf))
    return W.fresh_bucket_counts(ages.withColumn("age_seconds", F.col("age_seconds") / 1440))


PARTS = """parts AS (SELECT wallet, mint, count(*) AS trades, count(*) FILTER (WHERE d <= 0.005::DOUBLE) AS ultra_early,
 count(*) FILTER (WHERE d > 0.005::DOUBLE AND d <= 0.02::DOUBLE) AS early, count(*) FILTER (WHERE d > 0.02::DOUBLE AND d <= 0.1::DOUBLE) AS moderate, min(block_time) AS first_time
 FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - real_token_reserves / 793100000000000.0::DOUBLE)) AS d FROM tape) GROUP BY ALL)"""
CLASS = """CASE WHEN launches = 0 THEN 'NO HISTORY' WHEN launches >= 20 AND ultra_early / launches::DOUBLE >= 0.4::DOUBLE THEN 'EARLY-LAUNCH SPECIALIST'
 WHEN launches >= 20 THEN 'RECURRING LAUNCH TRADER' WHEN launches >= 5 THEN 'OCCASIONAL LAUNCH TRADER' ELSE 'OCCASIONAL TRADER' END AS history_class"""
TOTALS = "totals AS (SELECT wallet, count(*) AS launches, sum(trades) AS trades, sum(ultra_early) AS ultra_early, sum(early) AS early, sum(moderate) AS moderate, min(first_time) AS first_seen FROM parts GROUP BY ALL)"


@query("entry_depth", "tape_l", sql="""
SELECT mint, wallet, signature, leg, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - real_token_reserves / 793100000000000.0::DOUBLE)), 6) AS entry_depth FROM tape""")
def _(spark, sf):
    depth = S.entry_depth(F.col("real_token_reserves"), F.lit(P.INITIAL_REAL_TOKENS).cast("long"))
    return B.tape_l(spark, sf).select("mint", "wallet", "signature", "leg", F.round(depth, 6).alias("entry_depth"))


HISTORY = f"""{FIRST}, {PARTS}, {TOTALS},
history AS (SELECT f.mint, f.wallet, t.launches - 1 AS launches, (t.trades - p.trades)::BIGINT AS trades, (t.ultra_early - p.ultra_early)::BIGINT AS ultra_early,
 (t.early - p.early)::BIGINT AS early, (t.moderate - p.moderate)::BIGINT AS moderate, first_seen
 FROM first_buys f JOIN totals t USING (wallet) JOIN parts p ON p.mint = f.mint AND p.wallet = f.wallet)"""


@query("wallet_history", "tape_c", sql=f"WITH {HISTORY} SELECT *, {CLASS} FROM history")
def _(spark, sf):
    tape = B.tape_c(spark, sf)
    return W.wallet_history(T.first_buys(tape), W.participation(tape))


@query("wallet_history_class", "tape_b", sql=f"WITH {PARTS}, {TOTALS} SELECT wallet, launches, ultra_early::BIGINT AS ultra_early, {CLASS} FROM (SELECT wallet, trades::BIGINT AS launches, ultra_early FROM totals)")
def _(spark, sf):
    totals = W.participation(B.tape_b(spark, sf)).groupBy("wallet").agg(F.sum("trades").alias("launches"), F.sum("ultra_early").alias("ultra_early"))
    return totals.withColumn("history_class", W.wallet_history_class(F.col("launches"), F.col("ultra_early")))


@query("recurring_groups", "tape_c", sql=f"""WITH {FIRST},
p AS (SELECT DISTINCT mint AS other_mint, wallet FROM tape)
SELECT mint, other_mint, count(*) AS wallets FROM first_buys JOIN p USING (wallet) WHERE mint <> other_mint GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, sf):
    tape = B.tape_c(spark, sf)
    return H.recurring_groups(T.first_buyers(tape, None), W.participation(tape))


@query("recurring_groups_hot_launch", "tape_b", sql=f"""WITH {FIRST}, e AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL}) AS k FROM first_buys),
p AS (SELECT DISTINCT mint AS other_mint, wallet FROM tape)
SELECT mint, other_mint, count(*) AS wallets FROM e JOIN p USING (wallet) WHERE k <= 50 AND mint <> other_mint GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    return H.recurring_groups(T.first_buyers(tape, 50), W.participation(tape), hot_degree=20)


@query("wallet_overlap_pairs", "tape_c", sql=f"""WITH {FIRST}, e AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL}) AS k FROM first_buys),
p AS (SELECT DISTINCT mint AS other, wallet FROM tape), n AS (SELECT wallet, count(*) - 1 AS n FROM p GROUP BY ALL),
m AS (SELECT e.mint, e.wallet, p.other FROM e JOIN p USING (wallet) WHERE k <= 25 AND other <> mint),
s AS (SELECT x.mint, x.wallet AS a, y.wallet AS b, count(*) AS shared_launches FROM m x JOIN m y ON x.mint = y.mint AND x.other = y.other AND x.wallet < y.wallet GROUP BY ALL)
SELECT mint, a, b, shared_launches, round(shared_launches / least(na.n, nb.n)::DOUBLE, 6) AS overlap FROM s JOIN n na ON na.wallet = a JOIN n nb ON nb.wallet = b""")
def _(spark, sf):
    tape = B.tape_c(spark, sf)
    return H.wallet_overlap_pairs(T.first_buyers(tape, 25), W.participation(tape)).withColumn("overlap", F.round("overlap", 6))


@query("wallet_overlap_pairs_hot", "tape_b", sql=f"""WITH {FIRST}, e AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL}) AS k FROM first_buys),
p AS (SELECT DISTINCT mint AS other, wallet FROM tape), n AS (SELECT wallet, count(*) - 1 AS n FROM p GROUP BY ALL),
m AS (SELECT e.mint, e.wallet, p.other FROM e JOIN p USING (wallet) WHERE k <= 25 AND other <> mint),
s AS (SELECT x.mint, x.wallet AS a, y.wallet AS b, count(*) AS shared_launches FROM m x JOIN m y ON x.mint = y.mint AND x.other = y.other AND x.wallet < y.wallet GROUP BY ALL)
SELECT mint, a, b, shared_launches, round(shared_launches / least(na.n, nb.n)::DOUBLE, 6) AS overlap FROM s JOIN n na ON na.wallet = a JOIN n nb ON nb.wallet = b""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    return H.wallet_overlap_pairs(T.first_buyers(tape, 25), W.participation(tape), hot_degree=24).withColumn("overlap", F.round("overlap", 6))


@query("compare_launches", "tape_c", "launches", sql="""
WITH p AS (SELECT mint AS mint_a, mint + 1 AS mint_b FROM launches), b AS (SELECT DISTINCT mint, wallet FROM tape WHERE is_buy),
s AS (SELECT mint_a, count(*) AS n FROM p JOIN b x ON x.mint = mint_a JOIN b y ON y.mint = mint_b AND y.wallet = x.wallet GROUP BY ALL)
SELECT mint_a, mint_b, coalesce(n, 0) AS shared_wallets, coalesce(la.creator = lb.creator, FALSE) AS same_creator
FROM p LEFT JOIN s USING (mint_a) LEFT JOIN launches la ON la.mint = mint_a LEFT JOIN launches lb ON lb.mint = mint_b""")
def _(spark, sf):
    made = B.launches(spark, sf)
    pairs = made.select(F.col("mint").alias("mint_a"), (F.col("mint") + 1).alias("mint_b"))
    return H.compare_launches(pairs, T.buys(B.tape_c(spark, sf)), made)


# --- creators ---------------------------------------------------------------------------------


@query("creator_history", "tape_s", "launches", sql="""
WITH n AS (SELECT creator, count(*) AS launches_total FROM launches GROUP BY ALL),
s AS (SELECT creator, count(*) AS k FROM tape JOIN launches USING (mint) WHERE NOT is_buy AND wallet = creator AND block_time >= graduated_at GROUP BY ALL)
SELECT mint, creator, launches_total, launches_total - 1 AS previous_launches, coalesce(k, 0) AS post_graduation_sells FROM launches JOIN n USING (creator) LEFT JOIN s USING (creator)""")
def _(spark, sf):
    return C.creator_history(B.launches(spark, sf), B.tape_s(spark, sf))


GRADS = """others AS (SELECT a.mint, a.creator, b.curve_complete AS done, row_number() OVER (PARTITION BY a.mint ORDER BY b.created_at DESC, b.mint DESC) AS r
 FROM launches a JOIN launches b ON a.creator = b.creator AND a.mint <> b.mint),
grads AS (SELECT l.mint, l.creator, count(o.mint) AS checked, count(*) FILTER (WHERE done) AS graduated FROM launches l LEFT JOIN others o ON o.mint = l.mint AND r <= 12 GROUP BY ALL)"""


@query("creator_graduations", "launches", sql=f"""WITH {GRADS}
SELECT mint, creator, checked, graduated, checked - graduated AS abandoned, round(CASE WHEN checked > 0 THEN graduated / checked::DOUBLE END, 6) AS graduation_rate FROM grads""")
def _(spark, sf):
    return C.creator_graduations(B.launches(spark, sf)).withColumn("graduation_rate", F.round("graduation_rate", 6))


UPSTREAM = "upstream AS (SELECT recipient AS address, arg_max(source, (block_time, signature, source, amount)) AS parent, arg_max(amount, (block_time, signature, source, amount)) AS amount FROM transfers GROUP BY ALL)"


@query("creator_funding", "launches", "transfers", sql=f"WITH {UPSTREAM} SELECT mint, creator, parent AS funding_source, amount AS funding_amount FROM launches LEFT JOIN upstream ON address = creator")
def _(spark, sf):
    return C.creator_funding(B.launches(spark, sf), M.upstream_of(B.transfers(spark, sf)))


@query("creator_links", "tape_c", "transfers", "entities", "launches", sql=f"""WITH {PATHS}, {UPSTREAM},
src AS (SELECT mint, creator, creator AS address FROM launches UNION SELECT mint, creator, parent FROM launches JOIN upstream ON address = creator),
nodes AS (SELECT mint, wallet, direct_funder AS address, parent, direct_funder FROM paths UNION SELECT mint, wallet, parent, parent, direct_funder FROM paths WHERE parent IS NOT NULL)
SELECT DISTINCT mint, creator, wallet, (CASE WHEN parent IS NULL THEN 1 ELSE 2 END)::INT AS hops, coalesce(parent || '>', '') || direct_funder || '>' || wallet AS path
FROM nodes JOIN src USING (mint, address) WHERE wallet <> creator""")
def _(spark, sf):
    p = paths(spark, sf, kinds=False)
    made = C.creator_funding(B.launches(spark, sf), M.upstream_of(B.transfers(spark, sf)))
    out = C.creator_links(p.select("mint", "wallet").withColumn("direct_funder", F.lit(None).cast("string")), p, made)
    return out.withColumn("path", F.array_join("path", ">"))


@query("creator_risk", "tape_s", "launches", sql=f"""WITH {GRADS},
n AS (SELECT creator, count(*) AS launches_total FROM launches GROUP BY ALL),
s AS (SELECT creator, count(*) AS k FROM tape JOIN launches USING (mint) WHERE NOT is_buy AND wallet = creator AND block_time >= graduated_at GROUP BY ALL),
j AS (SELECT mint, mint % 5 AS linked, launches_total, launches_total - 1 AS prev, coalesce(k, 0) AS sells, CASE WHEN checked > 0 THEN graduated / checked::DOUBLE END AS rate
 FROM grads JOIN n USING (creator) LEFT JOIN s USING (creator))
SELECT mint, round_even(least(100.0::DOUBLE, (CASE WHEN linked > 0 THEN least(40, 12 * linked) ELSE 0 END + CASE WHEN prev >= 20 THEN 20 WHEN prev >= 5 THEN 12 WHEN prev > 0 THEN 5 ELSE 0 END
 + CASE WHEN rate <= 0.1::DOUBLE AND launches_total > 3 THEN 15 ELSE 0 END + CASE WHEN sells > 0 THEN 10 ELSE 0 END)::DOUBLE), 0)::INT AS creator_risk FROM j""")
def _(spark, sf):
    made = B.launches(spark, sf)
    rows = C.creator_history(made, B.tape_s(spark, sf)).join(C.creator_graduations(made).drop("creator"), "mint")
    return C.creator_risk(rows.withColumn("linked", F.col("mint") % 5)).select("mint", "creator_risk")


# --- holders -------------------------------------------------------------------------------------

LABELLED = "labelled AS (SELECT h.*, entity_type, label FROM holders h LEFT JOIN entities ON address = owner)"


def labelled(spark, sf):
    holders = B.holders(spark, sf).withColumnRenamed("owner", "address")
    out = E.classify_entities(holders, B.entities(spark, sf))
    return out.withColumnRenamed("address", "owner")


@query("holders_by_priority", "holders", "launches", sql="""
WITH r AS (SELECT *, CASE provider WHEN 'helius' THEN 0 WHEN 'solscan' THEN 1 ELSE 2 END AS p FROM holders WHERE amount > 0),
b AS (SELECT mint, min(p) AS p FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner) AS position FROM r JOIN b USING (mint, p))
SELECT mint, owner, amount, provider, position::INT AS position, CASE WHEN p < 2 THEN 'complete' ELSE 'partial' END AS coverage FROM t WHERE position <= 5
UNION ALL SELECT mint, NULL, NULL, NULL, NULL, 'missing' FROM launches WHERE mint NOT IN (SELECT mint FROM b)""")
def _(spark, sf):
    return O.holders_by_priority(B.holders(spark, sf), B.launches(spark, sf), 5)


@query("top_holders", "holders", "entities", sql=f"""WITH {LABELLED}
SELECT * FROM (SELECT mint, owner, amount, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner)::INT AS position FROM labelled WHERE entity_type IS NULL AND amount > 0) WHERE position <= 10""")
def _(spark, sf):
    return O.top_holders(labelled(spark, sf), 10)


@query("excluded_holders", "holders", "entities", sql=f"WITH {LABELLED} SELECT mint, owner, amount, label AS reason FROM labelled WHERE entity_type IS NOT NULL AND amount > 0")
def _(spark, sf):
    return O.excluded_holders(labelled(spark, sf))


CONCENTRATION = """t AS (SELECT mint, amount, owner, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner) AS k, row_number() OVER (PARTITION BY mint ORDER BY amount, owner) AS i FROM kept)
SELECT mint, sum(amount) AS total_held, count(*) AS holder_count, round(sum(amount) FILTER (WHERE k <= 1) / sum(amount), 6) AS top_1_share,
 round(sum(amount) FILTER (WHERE k <= 5) / sum(amount), 6) AS top_5_share, round(sum(amount) FILTER (WHERE k <= 10) / sum(amount), 6) AS top_10_share,
 round(2.0::DOUBLE * sum(i * amount) / (count(*) * sum(amount)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini FROM t GROUP BY mint"""


@query("holder_concentration", "holders", "entities", sql=f"WITH {LABELLED}, kept AS (SELECT * FROM labelled WHERE entity_type IS NULL AND amount > 0), {CONCENTRATION}")
def _(spark, sf):
    out = O.holder_concentration(labelled(spark, sf))
    return out.select("mint", "total_held", "holder_count", *r6("top_1_share", "top_5_share", "top_10_share", "gini"))


@query("gini", "tape_b", sql="""SELECT mint, round(2.0::DOUBLE * sum(i * quote_amount) / (count(*) * sum(quote_amount)) - (count(*) + 1.0::DOUBLE) / count(*), 6) AS gini
FROM (SELECT mint, quote_amount, row_number() OVER (PARTITION BY mint ORDER BY quote_amount) AS i FROM tape) GROUP BY mint""")
def _(spark, sf):
    return O.gini(B.tape_b(spark, sf), ["mint"], "quote_amount").select("mint", *r6("gini"))


# --- exits --------------------------------------------------------------------------------------------

EXITS = """ex AS (SELECT mint, wallet, coalesce(sum(token_amount) FILTER (WHERE is_buy), 0) AS bought, coalesce(sum(token_amount) FILTER (WHERE NOT is_buy), 0) AS sold,
 count(*) FILTER (WHERE NOT is_buy) AS sells, min(block_time) FILTER (WHERE NOT is_buy) AS first_sell_time, min(block_time) FILTER (WHERE is_buy) AS first_buy_time FROM tape GROUP BY ALL),
exits AS (SELECT *, CASE WHEN bought > 0 THEN sold / bought ELSE 0 END AS f, least(1.0::DOUBLE, CASE WHEN bought > 0 THEN sold / bought ELSE 0 END) AS sold_fraction,
 CASE WHEN bought > 0 AND sold / bought >= 0.95::DOUBLE THEN 'full' WHEN bought > 0 AND sold / bought > 0.01::DOUBLE THEN 'partial' ELSE 'holding' END AS exit_kind,
 (first_sell_time - first_buy_time)::DOUBLE AS hold_seconds FROM ex)"""


@query("wallet_exits", "tape_l", sql=f"WITH {EXITS} SELECT mint, wallet, bought, sold, sells, round(sold_fraction, 6) AS sold_fraction, exit_kind, first_sell_time, hold_seconds FROM exits")
def _(spark, sf):
    return X.wallet_exits(B.tape_l(spark, sf)).withColumn("sold_fraction", F.round("sold_fraction", 6))


@query("exit_signatures", "tape_l", sql=f"""
SELECT mint, wallet, string_agg(signature, ',' ORDER BY k) AS signatures FROM (SELECT *, row_number() OVER (PARTITION BY mint, wallet ORDER BY {B.ORDER_SQL}) AS k FROM tape WHERE NOT is_buy) WHERE k <= 5 GROUP BY ALL""")
def _(spark, sf):
    return X.exit_signatures(B.tape_l(spark, sf)).withColumn("signatures", F.array_join("signatures", ","))


def month_clusters(spark, sf):
    return slot_clusters(B.tape_b(spark, sf))


@query("sync_exit_groups", "tape_b", sql=f"""WITH RECURSIVE {CLUSTERS}, {EXITS},
s AS (SELECT mint, cluster_id, wallet, first_sell_time AS t, row_number() OVER (PARTITION BY mint, cluster_id ORDER BY first_sell_time, wallet::VARCHAR) AS i
 FROM members JOIN exits USING (mint, wallet) WHERE exit_kind <> 'holding' AND first_sell_time IS NOT NULL),
walk AS (SELECT mint, cluster_id, i, wallet, t, t AS anchor, 1 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.mint, s.cluster_id, s.i, s.wallet, s.t, CASE WHEN s.t - anchor > {120 * DAY} THEN s.t ELSE anchor END, CASE WHEN s.t - anchor > {120 * DAY} THEN g + 1 ELSE g END
 FROM walk w JOIN s ON s.mint = w.mint AND s.cluster_id = w.cluster_id AND s.i = w.i + 1)
SELECT mint, cluster_id, g::INT AS exit_group, count(*) AS wallets, min(t) AS first_time, max(t) AS last_time,
 array_to_string(list_sort(list(wallet::VARCHAR)), ',') AS members FROM walk GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    out = X.sync_exit_groups(slot_clusters(tape), X.wallet_exits(tape), window=120 * DAY)
    return out.withColumn("members", F.array_join("members", ","))


def easing(t):
    return f"0.5::DOUBLE * (1 + cos(pi() * ({t})))"


def sql_timing(t, window):
    return f"CASE WHEN count({t}) < 2 THEN 0 ELSE {easing(f'least(1.0::DOUBLE, (max({t}) - min({t})) / {float(window)}::DOUBLE)')} END"


def sql_amount(x, lo=0.02, hi=0.60):
    cv = f"(CASE WHEN avg({x}) <> 0 THEN stddev_pop({x}) / abs(avg({x})) ELSE 0 END)"
    return f"CASE WHEN count({x}) < 2 THEN 0 WHEN {cv} <= {lo}::DOUBLE THEN 1 WHEN {cv} >= {hi}::DOUBLE THEN 0 ELSE {easing(f'({cv} - {lo}::DOUBLE) / {hi - lo}::DOUBLE')} END"


@query("sell_coordination", "tape_b", sql=f"""WITH {CLUSTERS}, {EXITS},
j AS (SELECT m.mint, m.cluster_id, exit_kind <> 'holding' AS s, first_sell_time AS t, sold_fraction AS f, hold_seconds FROM members m JOIN exits USING (mint, wallet)),
k AS (SELECT mint, cluster_id, s, hold_seconds, CASE WHEN s THEN t END AS t, CASE WHEN s THEN f END AS f FROM j),
a AS (SELECT mint, cluster_id, count(*) FILTER (WHERE s) AS sellers, count(*) FILTER (WHERE NOT s) AS holders, median(hold_seconds) AS median_hold,
 {sql_timing('t', 120 * DAY)} AS timing, {sql_amount('f')} AS size_similarity FROM k GROUP BY ALL)
SELECT mint, cluster_id, sellers, holders, round(median_hold, 6) AS median_hold, round(timing, 6) AS timing, round(size_similarity, 6) AS size_similarity,
 round(CASE WHEN sellers >= 2 THEN timing * (0.6::DOUBLE + 0.4::DOUBLE * size_similarity) ELSE 0 END, 6) AS sell_coordination FROM a""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    out = X.sell_coordination(slot_clusters(tape), X.wallet_exits(tape), window=120 * DAY)
    return out.select("mint", "cluster_id", "sellers", "holders", *r6("median_hold", "timing", "size_similarity", "sell_coordination"))


@query("post_graduation", "tape_l", "launches", sql="""
WITH w AS (SELECT mint, wallet, max(block_time) FILTER (WHERE NOT is_buy) AS last, count(*) FILTER (WHERE is_buy) AS b FROM tape GROUP BY ALL)
SELECT mint, wallet, CASE WHEN last >= graduated_at THEN 'sold_after' WHEN last IS NOT NULL THEN 'sold_before' ELSE 'held' END AS behaviour
FROM w JOIN launches USING (mint) WHERE graduated_at IS NOT NULL AND b > 0""")
def _(spark, sf):
    return X.post_graduation(B.tape_l(spark, sf), B.launches(spark, sf))


# --- risk and fingerprints ------------------------------------------------------------------------------


def buyer_rows(spark, sf):
    """First buys with age, entry, funding delay, history and exits (times scaled from days to minutes)."""
    tape = B.tape_c(spark, sf)
    first = T.first_buys(tape)
    ages = W.wallet_age(first, B.launches(spark, sf), B.wallet_tx(spark, sf))
    minute = 1.0 / 1440
    rows = (
        T.with_seconds(first, B.launches(spark, sf)).select("mint", "wallet", "quote_amount", (F.col("seconds_after_launch") * minute).alias("seconds_after_launch"))
        .join(ages.select("mint", "wallet", (F.col("age_seconds") * minute).alias("age_seconds"), "first_action"), ["mint", "wallet"])
        .join(W.wallet_history(first, W.participation(tape)).select("mint", "wallet", "launches"), ["mint", "wallet"])
        .join(X.wallet_exits(tape).select("mint", "wallet", "sold_fraction", (F.col("hold_seconds") * minute).alias("hold_seconds"), (F.col("sells") > 0).alias("has_sells")), ["mint", "wallet"])
    )
    return rows.withColumn("funding_amount", F.col("quote_amount") / 3000).withColumn(
        "funding_to_buy_seconds", F.col("seconds_after_launch") / 2
    ).withColumn("quote_amount", F.col("quote_amount") / 4000).withColumn(
        "entity_type", F.when(F.col("mint") % 9 == 0, "CEX").otherwise("BUYER")
    )


BUYER_ROWS = f"""{AGES}, {PARTS}, {EXITS}, n AS (SELECT wallet, count(*) - 1 AS launches FROM parts GROUP BY ALL),
rows_ AS (SELECT f.mint, f.wallet, f.quote_amount / 4000 AS quote_amount, f.quote_amount / 3000 AS funding_amount, greatest(0, f.block_time - created_at) * (1.0::DOUBLE / 1440) AS entry,
 greatest(0, f.block_time - created_at) * (1.0::DOUBLE / 1440) / 2 AS delay, a.age_seconds * (1.0::DOUBLE / 1440) AS age, first_action, launches, sold_fraction,
 hold_seconds * (1.0::DOUBLE / 1440) AS hold, sells > 0 AS has_sells, CASE WHEN f.mint % 9 = 0 THEN 'CEX' ELSE 'BUYER' END AS entity_type
 FROM first_buys f JOIN launches USING (mint) JOIN ages a ON a.mint = f.mint AND a.wallet = f.wallet JOIN n ON n.wallet = f.wallet JOIN exits x ON x.mint = f.mint AND x.wallet = f.wallet)""".replace("JOIN launches USING (mint)", "JOIN launches l ON l.mint = f.mint")


@query("early_buyer_risk", "tape_c", "wallet_tx", "launches", sql=f"""WITH {BUYER_ROWS.replace('launches, sold_fraction', 'n.launches AS past, sold_fraction')}
SELECT mint, wallet, (CASE WHEN entity_type = 'CEX' THEN 0 ELSE least(100, CASE WHEN age < 60 THEN 25 WHEN age < 600 THEN 18 WHEN age < 86400 THEN 8 ELSE 0 END
 + CASE WHEN delay <= 10 THEN 22 WHEN delay <= 120 THEN 12 ELSE 0 END + CASE WHEN first_action THEN 15 ELSE 0 END
 + CASE WHEN entry <= 5 THEN 18 WHEN entry <= 30 THEN 10 ELSE 0 END + CASE WHEN past >= 20 THEN 10 ELSE 0 END) END)::INT AS risk_score FROM rows_""")
def _(spark, sf):
    return W.early_buyer_risk(buyer_rows(spark, sf)).select("mint", "wallet", "risk_score")


def _ladder(x, steps, last, op="<", missing="unknown"):
    return f"CASE WHEN {x} IS NULL THEN '{missing}' " + " ".join(f"WHEN {x} {op} {b} THEN '{n}'" for n, b in steps) + f" ELSE '{last}' END"


AMOUNTS = (("dust", 0.1), ("small", 0.5), ("medium", 2), ("large", 10))
PRINTS = f"""{BUYER_ROWS.replace('launches, sold_fraction', 'n.launches AS past, sold_fraction')},
prints AS (SELECT mint, wallet, {_ladder('age', (('seconds', 60), ('minutes', 3600), ('hours', 86400), ('days', 604800)), 'weeks+')} AS age,
 {_ladder('funding_amount', AMOUNTS, 'whale')} AS funding, {_ladder('entry', (('instant', 5), ('ultra_early', 30), ('early', 300), ('mid', 1800)), 'late', '<=')} AS entry_timing,
 {_ladder('quote_amount', AMOUNTS, 'whale')} AS entry_size, {_ladder('hold', (('flip', 60), ('short', 900), ('day', 86400)), 'long', missing='holding')} AS holding,
 CASE WHEN NOT has_sells THEN 'none' WHEN sold_fraction >= 0.95::DOUBLE THEN 'full_exit' WHEN sold_fraction >= 0.4::DOUBLE THEN 'majority_exit' ELSE 'partial_exit' END AS sells,
 {_ladder('past', (('first_time', 1), ('occasional', 5), ('regular', 20), ('frequent', 100)), 'industrial')} AS frequency FROM rows_)"""


@query("wallet_fingerprint", "tape_c", "wallet_tx", "launches", sql=f"WITH {PRINTS} SELECT * FROM prints")
def _(spark, sf):
    return W.wallet_fingerprint(buyer_rows(spark, sf))


@query("fingerprint_pairs", "tape_c", "wallet_tx", "launches", sql=f"""WITH {PRINTS},
c AS (SELECT mint, age, funding, entry_timing, entry_size, holding, sells, frequency, concat_ws('/', age, funding, entry_timing, entry_size, holding, sells, frequency) AS cls, count(*) AS n FROM prints GROUP BY ALL),
p AS (SELECT a.mint, a.cls AS class_a, b.cls AS class_b, a.n AS wallets_a, b.n AS wallets_b, (a.age = b.age)::INT + (a.funding = b.funding)::INT + (a.entry_timing = b.entry_timing)::INT
 + (a.entry_size = b.entry_size)::INT + (a.holding = b.holding)::INT + (a.sells = b.sells)::INT + (a.frequency = b.frequency)::INT AS k FROM c a JOIN c b ON a.mint = b.mint AND a.cls < b.cls)
SELECT mint, class_a, class_b, wallets_a, wallets_b, round(k / 7.0::DOUBLE, 6) AS similarity FROM p WHERE k >= 5
UNION ALL SELECT mint, cls, cls, n, n, 1.0::DOUBLE FROM c WHERE n > 1""")
def _(spark, sf):
    return W.fingerprint_pairs(W.wallet_fingerprint(buyer_rows(spark, sf)), 5).withColumn("similarity", F.round("similarity", 6))


@query("balance_after_purchase", "tape_c", "transfers", sql=f"""WITH {FUNDING}
SELECT mint, wallet, round(CASE WHEN balance_after_funding IS NOT NULL THEN greatest(0.0::DOUBLE, balance_after_funding - quote_amount) END, 6) AS balance_after_purchase FROM funding""")
def _(spark, sf):
    first = T.first_buys(B.tape_c(spark, sf))
    f = M.asof_funding(first, B.transfers(spark, sf))
    out = f.join(first.select("mint", "wallet", "quote_amount"), ["mint", "wallet"])
    return out.select("mint", "wallet", F.round(W.balance_after_purchase(F.col("balance_after_funding"), F.col("quote_amount")), 6).alias("balance_after_purchase"))
