"""Entities, funding and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintweave.catalog.registry import query
from mintweave.catalog.tape import FIRST, r6
from mintweave.functions import scalars as S
from mintweave.operators import entities as E
from mintweave.operators import funding as M
from mintweave.operators import tape as T
from mintweave.session import cut
from mintweave.sources import bindings as B

# The data's time unit is a day, so a day-wide bucket of the as-of join spans half a year here.
WIDTH = 180 * B.DAY
KEYWORDS = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{x}}), '{'|'.join(w.replace('.', '[.]') for w in words)}') THEN '{kind}'" for kind, words in S.LABEL_KEYWORDS
) + " END"
INFRA = "(" + ", ".join(f"'{k}'" for k in S.INFRASTRUCTURE_TYPES) + ")"


@query("label_text_to_entity", "entities", sql=f"SELECT address, label, {KEYWORDS.format(x='label')} AS entity_type FROM provider_labels")
def _(spark, sf):
    return B.provider_labels(spark, sf).withColumn("entity_type", S.label_to_entity(F.col("label")))


@query("is_infrastructure", "entities", sql=f"SELECT address, coalesce({KEYWORDS.format(x='label')} IN {INFRA}, FALSE) AS is_infrastructure FROM provider_labels")
def _(spark, sf):
    return B.provider_labels(spark, sf).select("address", S.is_infrastructure(S.label_to_entity(F.col("label"))).alias("is_infrastructure"))


ADDRESSES = "addresses AS (SELECT DISTINCT source AS address FROM transfers)"
CLASSIFIED = f"""labelled AS (SELECT a.address, CASE WHEN e.entity_type IS NOT NULL THEN e.label ELSE p.label END AS label,
 coalesce(e.entity_type, {KEYWORDS.format(x='p.label')}, '{{default}}') AS entity_type,
 CASE WHEN e.entity_type IS NOT NULL THEN e.source WHEN p.label IS NOT NULL THEN 'provider_label' ELSE 'none' END AS label_source,
 (CASE WHEN e.entity_type IS NOT NULL THEN e.confidence WHEN {KEYWORDS.format(x='p.label')} IS NOT NULL THEN 0.7 WHEN p.label IS NOT NULL THEN 0.4 ELSE 0.0 END)::DOUBLE AS confidence
 FROM addresses a LEFT JOIN entities e USING (address) LEFT JOIN provider_labels p USING (address))"""


@query("classify_entities", "transfers", "entities", sql=f"WITH {ADDRESSES}, {CLASSIFIED.format(default='UNKNOWN')} SELECT * FROM labelled")
def _(spark, sf):
    addresses = B.transfers(spark, sf).select(F.col("source").alias("address")).distinct()
    return E.classify_entities(addresses, B.entities(spark, sf), B.provider_labels(spark, sf))


@query("fanout", "transfers", sql="SELECT source AS address, count(DISTINCT recipient) AS fanout FROM transfers GROUP BY ALL")
def _(spark, sf):
    return E.fanout(B.transfers(spark, sf).select(F.col("source").alias("address"), "recipient"))


@query("activity", "wallet_tx", sql="SELECT address, count(*) AS activity FROM wallet_tx GROUP BY ALL")
def _(spark, sf):
    return E.activity(B.wallet_tx(spark, sf))


@query("assess_funders", "transfers", "entities", sql=f"""
WITH {ADDRESSES}, {CLASSIFIED.format(default='FUNDER')},
f AS (SELECT source AS address, count(DISTINCT recipient) AS fanout FROM transfers GROUP BY ALL),
x AS (SELECT source AS address, count(*) AS activity FROM transfers GROUP BY ALL),
j AS (SELECT l.*, fanout, activity, entity_type = 'CEX' AS c, entity_type IN {INFRA} AS i, fanout >= 60 AS w, activity >= 40 AS b
 FROM labelled l JOIN f USING (address) JOIN x USING (address))
SELECT address, label, fanout, activity, confidence,
 CASE WHEN c OR i THEN entity_type WHEN w OR b THEN 'INFRASTRUCTURE' ELSE 'FUNDER' END AS entity_type,
 CASE WHEN c OR i THEN label_source WHEN w THEN 'inferred:fanout' WHEN b THEN 'inferred:activity' ELSE label_source END AS label_source,
 (CASE WHEN c THEN 0.2 WHEN i THEN 0.0 WHEN w OR b THEN 0.2 ELSE 1.0 END)::DOUBLE AS weight, c OR i OR w OR b AS shared FROM j""")
def _(spark, sf):
    t = B.transfers(spark, sf).select(F.col("source").alias("address"), "recipient")
    out = E.assess_funders(
        t, B.entities(spark, sf), E.fanout(t), E.activity(t), B.provider_labels(spark, sf), activity_threshold=40
    )
    return out.drop("reason")


@query("registry_summary", "entities", sql="SELECT entity_type, count(*) AS entries, count(*) FILTER (WHERE verify) AS needs_verification FROM entities GROUP BY ALL")
def _(spark, sf):
    return E.registry_summary(B.entities(spark, sf))


@query("entity_addresses_by_type", "transfers", "entities", sql=f"WITH {ADDRESSES}, {CLASSIFIED.format(default='UNKNOWN')} SELECT entity_type, address FROM labelled")
def _(spark, sf):
    addresses = B.transfers(spark, sf).select(F.col("source").alias("address")).distinct()
    return E.entity_addresses_by_type(E.classify_entities(addresses, B.entities(spark, sf), B.provider_labels(spark, sf)))


@query("entity_overrides", "entities", sql="""
WITH o AS (SELECT 'S' || s_suppkey AS address, s_name AS label, 'VAULT' AS entity_type, 'operator' AS source, 1.0::DOUBLE AS confidence, FALSE AS verify FROM supplier WHERE s_nationkey IN (1, 3, 7))
SELECT * FROM o UNION ALL SELECT * FROM entities WHERE address NOT IN (SELECT address FROM o)""")
def _(spark, sf):
    over = B.table(spark, sf, "supplier").filter("s_nationkey in (1, 3, 7)").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("address"), F.col("s_name").alias("label"),
        F.lit("VAULT").alias("entity_type"), F.lit("operator").alias("source"), F.lit(1.0).alias("confidence"), F.lit(False).alias("verify"),
    )
    return E.entity_overrides(B.entities(spark, sf), over)


@query("inflow_events", "deltas", sql="""
WITH s AS (SELECT *, first_value(address) OVER (PARTITION BY signature ORDER BY CASE WHEN delta < 0 THEN delta ELSE 0 END, address) AS payer,
  min(delta) OVER (PARTITION BY signature) AS worst FROM sol_deltas WHERE success),
sol AS (SELECT CASE WHEN worst < 0 THEN payer END AS source, address AS recipient, 'SOL' AS asset, delta / 1e9::DOUBLE AS amount, signature, block_time FROM s WHERE delta / 1e9::DOUBLE >= 0.001::DOUBLE),
t AS (SELECT *, first_value(owner) OVER (PARTITION BY signature ORDER BY CASE WHEN delta < 0 THEN delta ELSE 0 END, owner) AS payer,
  min(delta) OVER (PARTITION BY signature) AS worst FROM token_deltas WHERE success),
usdc AS (SELECT CASE WHEN worst < 0 THEN payer END AS source, owner AS recipient, 'USDC' AS asset, delta / 1e6::DOUBLE AS amount, signature, block_time FROM t WHERE delta / 1e6::DOUBLE >= 0.5::DOUBLE)
SELECT source, recipient, asset, round(amount, 6) AS amount, signature, block_time FROM sol
UNION ALL SELECT source, recipient, asset, round(amount, 6), signature, block_time FROM usdc WHERE NOT EXISTS (SELECT 1 FROM sol WHERE sol.signature = usdc.signature AND sol.recipient = usdc.recipient)""")
def _(spark, sf):
    out = M.inflow_events(B.sol_deltas(spark, sf), B.token_deltas(spark, sf))
    return out.select("source", "recipient", "asset", F.round("amount", 6).alias("amount"), "signature", "block_time")


@query("upstream_of", "transfers", sql="""
SELECT address, parent, amount, block_time, signature FROM (SELECT recipient AS address, source AS parent, amount, block_time, signature,
 row_number() OVER (PARTITION BY recipient ORDER BY block_time DESC, slot DESC, signature DESC, source DESC, amount DESC) AS r FROM transfers) WHERE r = 1""")
def _(spark, sf):
    return M.upstream_of(B.transfers(spark, sf))


FUNDING = f"""{FIRST},
ranked AS (SELECT f.mint, f.wallet, f.block_time AS buy_time, t.source, t.amount, t.block_time, t.slot, t.signature, t.recipient_after,
  row_number() OVER (PARTITION BY f.mint, f.wallet ORDER BY t.block_time DESC, t.slot DESC, t.signature DESC, t.source DESC, t.amount DESC) AS r
 FROM first_buys f JOIN transfers t ON t.recipient = f.wallet AND t.block_time < f.block_time),
funding AS (SELECT f.mint, f.wallet, f.signature AS buy_signature, f.fee_payer, f.block_time AS buy_time, f.quote_amount, source AS direct_funder, amount AS funding_amount,
  ranked.block_time AS funding_time, ranked.signature AS funding_signature, (f.block_time - ranked.block_time)::DOUBLE AS funding_to_buy_seconds,
  ranked.recipient_after AS balance_after_funding,
  f.wallet IN (SELECT recipient FROM transfers) AS observed
 FROM first_buys f LEFT JOIN ranked ON ranked.mint = f.mint AND ranked.wallet = f.wallet AND r = 1)"""


@query("asof_funding", "tape_c", "transfers", sql=f"WITH {FUNDING} SELECT mint, wallet, direct_funder, funding_amount, funding_time, funding_signature, funding_to_buy_seconds, observed FROM funding")
def _(spark, sf):
    out = M.asof_funding(T.first_times(B.tape_c(spark, sf)), M.money(B.transfers(spark, sf)), width=WIDTH)
    return out.select("mint", "wallet", "direct_funder", "funding_amount", "funding_time", "funding_signature", "funding_to_buy_seconds", "observed")


@query("asof_funding_lookback", "tape_c", "transfers", "wallet_tx", sql=f"""
WITH {FIRST}, ins AS (SELECT DISTINCT recipient, signature FROM transfers),
rows_ AS (SELECT address AS wallet, w.signature, block_time, slot, TRUE AS keep FROM wallet_tx w WHERE err IS NULL OR (address, w.signature) IN (SELECT (recipient, signature) FROM ins)),
tx AS (SELECT wallet, signature, block_time, NULL AS source FROM rows_ WHERE (wallet, signature) NOT IN (SELECT (recipient, signature) FROM ins)
 UNION ALL SELECT recipient, signature, block_time, source FROM transfers),
ranked AS (SELECT f.mint, f.wallet, tx.source, tx.signature, tx.block_time, row_number() OVER (PARTITION BY f.mint, f.wallet ORDER BY tx.block_time DESC, tx.signature DESC, tx.source DESC NULLS LAST) AS r
 FROM first_buys f JOIN tx ON tx.wallet = f.wallet AND tx.block_time < f.block_time),
hit AS (SELECT *, row_number() OVER (PARTITION BY mint, wallet ORDER BY r) AS k FROM ranked WHERE r <= 3 AND source IS NOT NULL)
SELECT f.mint, f.wallet, hit.source AS direct_funder, hit.signature AS funding_signature FROM first_buys f LEFT JOIN hit ON hit.mint = f.mint AND hit.wallet = f.wallet AND k = 1""")
def _(spark, sf):
    out = M.asof_funding(T.first_buys(B.tape_c(spark, sf)), B.transfers(spark, sf), B.wallet_tx(spark, sf), lookback=3, width=WIDTH)
    return out.select("mint", "wallet", "direct_funder", "funding_signature")


@query("fee_payer_fallback", "tape_s", "transfers", "deltas", sql=f"""WITH {FUNDING},
d AS (SELECT signature, address, sum(delta) AS delta FROM sol_deltas GROUP BY ALL)
SELECT mint, wallet, coalesce(direct_funder, fee_payer) AS direct_funder,
 round(CASE WHEN direct_funder IS NULL THEN abs(coalesce(delta, 0)) / 1e9::DOUBLE ELSE funding_amount END, 6) AS funding_amount,
 coalesce(funding_to_buy_seconds, 0.0::DOUBLE) AS funding_to_buy_seconds
FROM funding LEFT JOIN d ON d.signature = buy_signature AND d.address = fee_payer""")
def _(spark, sf):
    first = T.first_buys(B.tape_s(spark, sf))
    out = M.fee_payer_fallback(M.asof_funding(first, B.transfers(spark, sf)), first, B.sol_deltas(spark, sf))
    return out.select("mint", "wallet", "direct_funder", F.round("funding_amount", 6).alias("funding_amount"), "funding_to_buy_seconds")


def funded(spark, sf, money=None):
    money = M.money(B.transfers(spark, sf)) if money is None else money
    return cut(M.asof_funding(T.first_times(B.tape_c(spark, sf)), money, width=WIDTH), "funding")


def paths(spark, sf, causal=True, f=None, judged=None, money=None, kinds=True):
    # upstream_of, which the newest inflows come from, reads amounts
    money = M.money(B.transfers(spark, sf), M.ROUTE if causal else M.MONEY) if money is None else money
    f = funded(spark, sf, money) if f is None else f
    if judged is None:
        judged = cut(M.assess_sources(M.funder_members(f), B.entities(spark, sf), scope="mint", fanout_threshold=4), "judged")
    return M.funding_paths(f, money, judged, scope="mint", causal=causal, width=WIDTH, kinds=kinds)


JUDGED = f"""fan AS (SELECT mint, direct_funder AS source, count(DISTINCT wallet) AS n FROM funding WHERE direct_funder IS NOT NULL GROUP BY ALL),
judged AS (SELECT mint, fan.source, n, CASE WHEN entity_type IS NOT NULL THEN entity_type WHEN n >= 4 THEN 'INFRASTRUCTURE' ELSE 'FUNDER' END AS kind FROM fan LEFT JOIN entities ON address = fan.source)"""
# The newest inflow before the payment, per (address, time).
UP = """ups AS (SELECT DISTINCT direct_funder AS address, funding_time AS t FROM funding WHERE direct_funder IS NOT NULL),
up AS (SELECT address, t, arg_max(source, (block_time, signature, source)) AS parent FROM ups JOIN transfers ON recipient = address AND block_time < t GROUP BY ALL)"""
PATHS = f"""{FUNDING}, {JUDGED}, {UP},
paths AS (SELECT f.mint, f.wallet, f.direct_funder, CASE WHEN j.kind = 'FUNDER' THEN up.parent END AS parent, j.kind
 FROM funding f JOIN judged j ON j.mint = f.mint AND j.source = f.direct_funder LEFT JOIN up ON up.address = f.direct_funder AND up.t = f.funding_time)"""


@query("funding_paths", "tape_c", "transfers", "entities", sql=f"""WITH {PATHS}
SELECT mint, wallet, coalesce(parent || '>', '') || direct_funder || '>' || wallet AS path, coalesce(parent, direct_funder) AS root,
 CASE WHEN parent IS NULL THEN kind ELSE 'FUNDER' END AS root_type, (CASE WHEN parent IS NULL THEN 1 ELSE 2 END)::INT AS hops FROM paths""")
def _(spark, sf):
    return paths(spark, sf).withColumn("path", F.array_join("path", ">"))


@query("funding_paths_newest", "tape_c", "transfers", "entities", sql=f"""WITH {FUNDING}, {JUDGED},
up AS (SELECT recipient AS address, arg_max(source, (block_time, signature, source)) AS parent FROM transfers GROUP BY ALL)
SELECT f.mint, f.wallet, CASE WHEN j.kind = 'FUNDER' THEN coalesce(parent, direct_funder) ELSE direct_funder END AS root,
 (CASE WHEN j.kind = 'FUNDER' AND parent IS NOT NULL THEN 2 ELSE 1 END)::INT AS hops
 FROM funding f JOIN judged j ON j.mint = f.mint AND j.source = f.direct_funder LEFT JOIN up ON up.address = f.direct_funder""")
def _(spark, sf):
    return paths(spark, sf, causal=False).select("mint", "wallet", "root", "hops")


@query("funder_groups", "tape_c", "transfers", sql=f"WITH {FUNDING} SELECT mint, direct_funder AS source, count(DISTINCT wallet) AS wallets FROM funding WHERE direct_funder IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return M.group_sizes(M.funder_members(funded(spark, sf)))


@query("largest_funder_group", "tape_c", "transfers", "entities", sql=f"""WITH {FUNDING},
g AS (SELECT mint, direct_funder AS source, count(DISTINCT wallet) AS wallets FROM funding WHERE direct_funder NOT IN (SELECT address FROM entities) GROUP BY ALL)
SELECT mint, source, wallets FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY wallets DESC, source) AS r FROM g) WHERE r = 1""")
def _(spark, sf):
    known = B.entities(spark, sf).select(F.col("address").alias("source"))
    return M.largest_funder_group(M.funder_members(funded(spark, sf)), known)


@query("intermediary_groups", "tape_c", "transfers", "entities", sql=f"""WITH {PATHS},
n AS (SELECT mint, direct_funder AS source, wallet FROM paths UNION SELECT mint, parent, wallet FROM paths WHERE parent IS NOT NULL)
SELECT mint, source, count(*) AS wallets FROM n GROUP BY ALL""")
def _(spark, sf):
    return M.group_sizes(M.intermediary_members(paths(spark, sf, kinds=False)))


@query("funding_coverage", "tape_l", "transfers", sql=f"""WITH {FIRST}, o AS (SELECT mint, ('S' || wallet) IN (SELECT recipient FROM transfers) AS observed FROM first_buys)
SELECT mint, round(avg(observed::INT), 6) AS coverage, CASE WHEN avg(observed::INT) >= 0.8 THEN 'complete' WHEN avg(observed::INT) > 0.2 THEN 'partial' ELSE 'missing' END AS level FROM o GROUP BY mint""")
def _(spark, sf):
    out = M.funding_coverage(M.asof_funding(T.first_buys(B.tape_s(spark, sf)), B.transfers(spark, sf), width=WIDTH))
    return out.withColumn("coverage", F.round("coverage", 6))


@query("funder_split", "tape_c", "transfers", "entities", sql=f"""WITH {FUNDING}, {JUDGED}
SELECT mint, source, n AS wallets, kind <> 'FUNDER' AS shared, (CASE kind WHEN 'FUNDER' THEN 1.0 WHEN 'CEX' THEN 0.2 WHEN 'INFRASTRUCTURE' THEN 0.2 ELSE 0.0 END)::DOUBLE AS weight FROM judged""")
def _(spark, sf):
    members = M.funder_members(funded(spark, sf))
    judged = M.assess_sources(members, B.entities(spark, sf), scope="mint", fanout_threshold=4)
    private, infra = M.split_by_assessment(members, judged, "mint")
    both = private.withColumn("shared", F.lit(False)).unionByName(infra.withColumn("shared", F.lit(True)))
    return both.groupBy("mint", "source", "shared", "weight").agg(F.count(F.lit(1)).alias("wallets"))


@query("fanout_marks_all_suppliers", "tape_c", "transfers", "entities", sql=f"""WITH {FUNDING},
fan AS (SELECT direct_funder AS address, count(DISTINCT wallet) AS fanout FROM funding WHERE direct_funder IS NOT NULL GROUP BY ALL)
SELECT address, fanout, entity_type IS NOT NULL OR fanout >= 60 AS shared FROM fan LEFT JOIN entities USING (address)""")
def _(spark, sf):
    judged = M.assess_sources(M.funder_members(funded(spark, sf)), B.entities(spark, sf))
    return judged.select("address", "fanout", "shared")
