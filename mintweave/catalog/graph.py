"""Wallet graph, components, communities, density groups, cluster building, recurrence, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from mintweave.catalog.funding import FUNDING, JUDGED, PATHS, funded, paths
from mintweave.catalog.registry import query
from mintweave.catalog.scoring import FACTS, LINKS, YEARS, facts, links, year_clusters
from mintweave.catalog.tape import CLUSTERS, DAY, FIRST, r6, slot_clusters
from mintweave.catalog.wallets import EXITS, UPSTREAM
from mintweave.functions import scalars as S
from mintweave.operators import clusters as K
from mintweave.operators import creator as C
from mintweave.operators import evidence as V
from mintweave.operators import execution as X
from mintweave.operators import funding as M
from mintweave.operators import graph as G
from mintweave.operators import history as H
from mintweave.operators import holders as O
from mintweave.operators import sells as Z
from mintweave.operators import tape as T
from mintweave.operators import wallets as W
from mintweave.session import cut
from mintweave.sources import bindings as B


def funder_groups(spark, sf, money=None):
    """Funding, and its private and infrastructure funder groups, of the customer tape."""
    f = funded(spark, sf, money)
    funders = M.funder_members(f)
    judged = cut(M.assess_sources(funders, B.entities(spark, sf), scope="mint", fanout_threshold=4), "judged")
    return f, funders, judged, *M.split_by_assessment(funders, judged, "mint")


def groups(spark, sf):
    """Funding, paths, private and infrastructure funder groups and private hops of the customer tape."""
    money = M.money(B.transfers(spark, sf), M.ROUTE)  # who paid whom; no amounts are asked for
    f, funders, judged, private, infra = funder_groups(spark, sf, money)
    p = paths(spark, sf, f=f, judged=judged, money=money, kinds=False)
    hops = M.intermediary_members(p).join(funders.select("mint", "source").distinct(), ["mint", "source"], "left_anti")
    return f, p, private, infra, hops.withColumn("weight", F.lit(1.0))


PRIVATE = "private AS (SELECT f.mint, direct_funder AS source, f.wallet FROM funding f JOIN judged j ON j.mint = f.mint AND j.source = direct_funder WHERE kind = 'FUNDER')"
HOPS = "hops AS (SELECT DISTINCT mint, parent AS source, wallet FROM paths WHERE parent IS NOT NULL AND (mint, parent) NOT IN (SELECT (mint, direct_funder) FROM funding WHERE direct_funder IS NOT NULL))"


@query("assoc_edges", "tape_c", "transfers", "entities", sql=f"""WITH {PATHS}, {PRIVATE}, {HOPS},
fp AS (SELECT a.mint, a.source, a.wallet AS src, b.wallet AS dst FROM private a JOIN private b ON a.mint = b.mint AND a.source = b.source AND a.wallet < b.wallet),
fn AS (SELECT mint, source, count(*) AS n FROM private GROUP BY ALL),
hp AS (SELECT a.mint, a.source, a.wallet AS src, b.wallet AS dst FROM hops a JOIN hops b ON a.mint = b.mint AND a.source = b.source AND a.wallet < b.wallet),
hn AS (SELECT mint, source, count(*) AS n FROM hops GROUP BY ALL),
e AS (SELECT fp.mint, src, dst, 1.0::DOUBLE / greatest(1.0::DOUBLE, sqrt(n - 1)) AS w, 'COMMON_FUNDER' AS rel FROM fp JOIN fn ON fn.mint = fp.mint AND fn.source = fp.source
 UNION ALL SELECT hp.mint, src, dst, 0.6::DOUBLE / greatest(1.0::DOUBLE, sqrt(n - 1)), 'COMMON_INTERMEDIARY' FROM hp JOIN hn ON hn.mint = hp.mint AND hn.source = hp.source)
SELECT mint, src, dst, round(sum(w), 6) AS weight, string_agg(rel, ',' ORDER BY rel) AS relations FROM e GROUP BY ALL""")
def _(spark, sf):
    f, _, private, _, hops = groups(spark, sf)
    out = G.assoc_edges(private, hops, f, f)  # the funding has a row for each buyer of each launch
    return out.select("mint", "src", "dst", F.round("weight", 6).alias("weight"), F.array_join("relations", ",").alias("relations"))


@query("private_funder_groups", "tape_c", "transfers", "entities", sql=f"WITH {FUNDING}, {JUDGED}, {PRIVATE} SELECT mint, source, count(*) AS wallets FROM private GROUP BY ALL")
def _(spark, sf):
    return M.group_sizes(funder_groups(spark, sf)[3])


@query("infrastructure_funders", "tape_c", "transfers", "entities", sql=f"WITH {FUNDING}, {JUDGED} SELECT DISTINCT mint, source FROM judged WHERE kind <> 'FUNDER'")
def _(spark, sf):
    return funder_groups(spark, sf)[4].select("mint", "source").distinct()


COMPONENTS = """links_ AS (SELECT a.mint, a.wallet AS u, b.wallet AS v FROM grp a JOIN grp b ON a.mint = b.mint AND a.source = b.source AND a.wallet <> b.wallet),
walk AS (SELECT DISTINCT mint, u AS wallet, u AS r FROM links_ UNION SELECT w.mint, l.v, w.r FROM walk w JOIN links_ l ON l.mint = w.mint AND l.u = w.wallet),
comps AS (SELECT mint, wallet, min(r) AS component FROM walk GROUP BY ALL)"""


@query("connected_components", "tape_c", "transfers", "entities", sql=f"""WITH RECURSIVE {PATHS}, {PRIVATE}, {HOPS},
grp AS (SELECT * FROM private UNION SELECT * FROM hops), {COMPONENTS} SELECT * FROM comps""")
def _(spark, sf):
    _, _, private, _, hops = groups(spark, sf)
    return G.group_components(private.select("mint", "source", "wallet").unionByName(hops.select("mint", "source", "wallet")))


@query("connected_components_hubs", sql="""WITH RECURSIVE n AS (SELECT DISTINCT 'o' || l_orderkey AS a, 's' || l_suppkey AS b FROM lineitem),
e AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
w AS (SELECT min(b) AS wallet FROM n UNION SELECT e.b FROM w JOIN e ON e.a = w.wallet),
rest AS (SELECT DISTINCT a AS wallet FROM e WHERE a NOT IN (SELECT wallet FROM w))
SELECT 0 AS mint, wallet, (SELECT min(wallet) FROM w) AS component FROM w UNION ALL SELECT 0, wallet, 'separate' FROM rest""")
def _(spark, sf):
    lines = B.table(spark, sf, "lineitem")
    edges = lines.select(F.lit(0).alias("mint"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()
    return G.connected_components(edges)


def associations(spark, sf):
    """Association edges including shared history, over all buyers."""
    f, _, private, _, hops = groups(spark, sf)
    overlaps = H.wallet_overlap_pairs(f, W.participation(B.tape_c(spark, sf)))
    return G.assoc_edges(private, hops, f, f, overlaps)


@query("communities")
def _(spark, sf):
    return G.communities(associations(spark, sf))


@query("community_modularity")
def _(spark, sf):
    return G.community_modularity(associations(spark, sf)).select("mint", *r6("modularity"))


def behaviour_profiles(spark, sf):
    made = cut(B.launches(spark, sf).select("mint", "created_at"), "made")
    first = cut(T.first_buyers(B.tape_c(spark, sf), None).select("mint", "wallet", "block_time", "slot", "quote_amount", "position"), "first")
    ages = W.wallet_age(first, made, B.wallet_tx(spark, sf)).select("mint", "wallet", "age_seconds")
    f = M.asof_funding(first, M.money(B.transfers(spark, sf)), width=180 * DAY).select("mint", "wallet", "funding_amount", "funding_to_buy_seconds")
    return T.with_seconds(first, made).join(ages, ["mint", "wallet"]).join(f, ["mint", "wallet"])


_FEATS = ["greatest(0, f.block_time - created_at)", "f.quote_amount", "coalesce(u.funding_amount, 0)", "coalesce(u.funding_to_buy_seconds, 0)", "coalesce(a.age_seconds, 86400)"]
FEATURES = f"""{FUNDING}, {FACTS.split('seen AS', 1)[1].join(['seen AS', '']).rsplit(',' + chr(10) + 'facts AS', 1)[0]},
raw AS (SELECT f.mint, f.wallet, row_number() OVER (PARTITION BY f.mint ORDER BY {', '.join('f.' + c for c in B.ORDER_SQL.split(', '))}) AS position, {', '.join(f'log10(1.0::DOUBLE + {x}) AS f{i}' for i, x in enumerate(_FEATS))}
 FROM first_buys f JOIN launches l ON l.mint = f.mint JOIN ages a ON a.mint = f.mint AND a.wallet = f.wallet JOIN funding u ON u.mint = f.mint AND u.wallet = f.wallet),
st AS (SELECT mint, count(*) AS n, {', '.join(f'avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}' for i in range(5))} FROM raw GROUP BY ALL),
feats AS (SELECT mint, wallet, position, {', '.join(f'(f{i} - m{i}) / (CASE WHEN s{i} > 1e-12::DOUBLE THEN s{i} ELSE 1 END) AS f{i}' for i in range(5))} FROM raw JOIN st USING (mint) WHERE n >= 3)"""


@query("log_features", "tape_c", "transfers", "wallet_tx", "launches", sql=f"WITH {FEATURES} SELECT mint, wallet, position::INT AS position, " + ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(5)) + " FROM feats")
def _(spark, sf):
    return G.behaviour_features(behaviour_profiles(spark, sf)).select("mint", "wallet", "position", *r6(*G.FEATURES))


NEAR = f"near AS (SELECT a.mint, a.wallet AS a, b.wallet AS b, b.position AS pb FROM feats a JOIN feats b ON a.mint = b.mint AND {' + '.join(f'(a.f{i} - b.f{i}) * (a.f{i} - b.f{i})' for i in range(5))} <= 0.5625::DOUBLE)"


@query("behaviour_neighbours", "tape_c", "transfers", "wallet_tx", "launches", sql=f"WITH {FEATURES}, {NEAR} SELECT mint, a AS wallet, count(*) AS neighbours, count(*) >= 3 AS is_core FROM near GROUP BY ALL")
def _(spark, sf):
    near = G.behaviour_neighbours(cut(G.behaviour_features(behaviour_profiles(spark, sf)), "features"))
    return near.groupBy("mint", F.col("a").alias("wallet")).agg(F.count(F.lit(1)).alias("neighbours"), (F.count(F.lit(1)) >= 3).alias("is_core"))


@query("behaviour_groups", "tape_c", "transfers", "wallet_tx", "launches", sql=f"""WITH RECURSIVE {FEATURES}, {NEAR},
cores AS (SELECT mint, a AS wallet FROM near GROUP BY ALL HAVING count(*) >= 3),
ln AS (SELECT n.mint, n.a, n.b FROM near n JOIN cores x ON x.mint = n.mint AND x.wallet = n.a JOIN cores y ON y.mint = n.mint AND y.wallet = n.b),
walk AS (SELECT DISTINCT mint, a AS wallet, a AS r FROM ln UNION SELECT w.mint, ln.b, w.r FROM walk w JOIN ln ON ln.mint = w.mint AND ln.a = w.wallet),
comp AS (SELECT mint, wallet, min(r) AS component FROM walk GROUP BY ALL),
firsts AS (SELECT comp.mint, component, min(position) AS p FROM comp JOIN feats ON feats.mint = comp.mint AND feats.wallet = comp.wallet GROUP BY ALL)
SELECT mint, wallet, component AS "group", TRUE AS is_core FROM comp
UNION ALL SELECT n.mint, n.a, arg_min(comp.component, p), FALSE FROM near n JOIN comp ON comp.mint = n.mint AND comp.wallet = n.b JOIN firsts ON firsts.mint = n.mint AND firsts.component = comp.component
 WHERE (n.mint, n.a) NOT IN (SELECT (mint, wallet) FROM cores) GROUP BY n.mint, n.a""")
def _(spark, sf):
    return G.behaviour_groups(cut(G.behaviour_features(behaviour_profiles(spark, sf)), "features"))


@query("execution_candidates", "tape_b", sql=f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY {B.ORDER_SQL}) AS k FROM tape WHERE is_buy), c AS (SELECT * FROM e WHERE k <= 100),
s AS (SELECT DISTINCT mint, fee_payer AS g, wallet FROM c WHERE fee_payer <> wallet), a AS (SELECT DISTINCT mint, signature AS g, wallet FROM c)
SELECT mint, 'sponsor' AS kind, array_to_string(list_sort(list(wallet::VARCHAR)), ',') AS members FROM s GROUP BY mint, g HAVING count(*) >= 2
UNION ALL SELECT mint, 'atomic', array_to_string(list_sort(list(wallet::VARCHAR)), ',') FROM a GROUP BY mint, g HAVING count(*) >= 2""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    out = K.candidates({"sponsor": X.sponsor_members(tape, 100), "atomic": X.atomic_members(tape, 100)})
    return out.select("mint", F.when(F.col("rank") == 1, "sponsor").otherwise("atomic").alias("kind"), F.array_join("members", ",").alias("members"))


def proposals(spark, sf):
    tape = B.tape_b(spark, sf)
    quarter = T.first_buyers(tape, 100).select("mint", F.floor(F.col("position") / 7).alias("source"), "wallet")
    half = T.first_buyers(tape, 100).select("mint", F.floor(F.col("position") / 13).alias("source"), "wallet")
    return K.candidates({"graph": quarter, "sponsor": X.sponsor_members(tape, 100), "atomic": X.atomic_members(tape, 100), "behaviour": half})


@query("merge_candidates")
def _(spark, sf):
    return K.merge_candidates(proposals(spark, sf)).select("mint", "order", F.array_join("members", ",").alias("members"), F.array_join("methods", "+").alias("methods"))


@query("build_clusters")
def _(spark, sf):
    return K.build_clusters(K.merge_candidates(proposals(spark, sf))).withColumn("members", F.array_join("members", ","))


# --- the display graph ------------------------------------------------------------------------------


def marked(buyers):
    """Buyers with the attributes that the graph shows."""
    none = F.lit(None).cast("string")
    return buyers.withColumn("entity_type", F.lit("BUYER")).withColumn("label", none).withColumn("sol_balance", F.lit(0.0)).withColumn(
        "age_seconds", F.lit(1.0)).withColumn("risk_score", F.col("mint") % 90)


def top_owners(spark, sf):
    return O.top_holders(B.holders(spark, sf).withColumn("entity_type", F.lit("UNKNOWN")).withColumn("label", F.lit(None).cast("string")), 25)


def drawn_nodes(made, profiles, creators, p, held):
    actors = M.intermediary_members(p).select("mint", F.col("source").alias("address")).distinct().withColumn("entity_type", F.lit("FUNDER")).withColumn("label", F.lit(None).cast("string"))
    return G.graph_nodes(made, profiles, creators.withColumn("creator_risk", F.col("mint") % 100), actors, held)


def drawn(spark, sf, keep=("block_time", "slot")):
    """What the edges are made from.  Buyers come from one pass of the tape, their inflows and paths from one as-of pass over the payments."""
    tape, made = B.tape_c(spark, sf), B.launches(spark, sf)
    sent = M.money(B.transfers(spark, sf), [n for n in M.MONEY if n != "asset"])
    profiles = marked(cut(T.buyers_with_positions(tape, keep), "buyers"))
    inflows = cut(G.wallet_inflows(profiles, sent, width=180 * DAY), "inflows")
    p = cut(paths(spark, sf, f=G.newest_funder(inflows), money=sent, kinds=False), "paths")
    return tape, made, C.creator_funding(made, M.upstream_of(sent)), profiles, inflows, p, top_owners(spark, sf)


DISPLAY = f"""{PATHS}, {UPSTREAM}, who AS (SELECT DISTINCT mint, wallet FROM first_buys),
held AS (SELECT mint, owner, amount FROM (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner) AS k FROM holders WHERE amount > 0) WHERE k <= 25),
steps AS (SELECT mint, direct_funder AS s, wallet AS d FROM paths UNION SELECT mint, parent, direct_funder FROM paths WHERE parent IS NOT NULL),
cf AS (SELECT mint, creator, parent AS funding_source, amount AS funding_amount FROM launches LEFT JOIN upstream ON address = creator)"""


@query("graph_nodes", "tape_c", "transfers", "entities", "launches", "holders", sql=f"""WITH {DISPLAY},
pos AS (SELECT mint, wallet, sum(CASE WHEN is_buy THEN token_amount ELSE -token_amount END) AS p FROM tape GROUP BY ALL),
n AS (SELECT mint, mint::VARCHAR AS node, 9 AS pr, 'token' AS role, 'TOKEN' AS entity_type, NULL::INT AS risk, NULL::DOUBLE AS position FROM launches
 UNION ALL SELECT mint, wallet, 2, 'wallet', 'BUYER', (mint % 90)::INT, p FROM who JOIN pos USING (mint, wallet)
 UNION ALL SELECT mint, creator, 3, 'wallet', 'CREATOR', (mint % 100)::INT, NULL FROM launches
 UNION ALL SELECT mint, s, 1, 'actor', 'FUNDER', NULL, NULL FROM steps
 UNION ALL SELECT mint, owner, 4, 'holder', 'UNKNOWN', NULL, amount FROM held)
SELECT mint, node, arg_max(role, pr) AS role, arg_max(entity_type, pr) AS entity_type, arg_max(risk, pr) FILTER (WHERE risk IS NOT NULL) AS risk, round(arg_max(position, pr) FILTER (WHERE position IS NOT NULL), 6) AS position FROM n GROUP BY ALL""")
def _(spark, sf):
    made = B.launches(spark, sf)
    profiles, p = marked(cut(T.buyer_positions(B.tape_c(spark, sf)), "buyers")), cut(paths(spark, sf, kinds=False), "paths")
    nodes = drawn_nodes(made, profiles, made.select("mint", "creator"), p, top_owners(spark, sf))
    return nodes.select("mint", "node", "role", "entity_type", "risk", F.round("position", 6).alias("position"))


EVENTS = """evs AS (SELECT * FROM (SELECT f.mint, f.wallet, t.source, t.amount, t.signature, row_number() OVER (PARTITION BY f.mint, f.wallet ORDER BY t.block_time DESC, t.signature DESC, t.source DESC, t.amount DESC) AS e
 FROM first_buys f JOIN (SELECT DISTINCT * FROM transfers) t ON t.recipient = f.wallet AND t.block_time < f.block_time) WHERE e <= 3)"""


@query("funding_events", "tape_c", "transfers", sql=f"WITH {FIRST}, {EVENTS} SELECT mint, wallet, source, round(amount, 6) AS amount, signature, e::INT AS event FROM evs")
def _(spark, sf):
    out = G.funding_events(T.first_times(B.tape_c(spark, sf)), B.transfers(spark, sf), width=180 * DAY)
    return out.select("mint", "wallet", "source", F.round("amount", 6).alias("amount"), "signature", "event")


EDGES = f"""{EVENTS},
tr AS (SELECT mint, wallet, signature, is_buy, arg_max(quote_amount, (block_time, slot, leg, token_amount, quote_amount)) AS amount FROM tape SEMI JOIN who USING (mint, wallet) GROUP BY ALL),
paid AS (SELECT DISTINCT mint, source AS src, wallet AS dst, 'fund:' || signature AS key, 'FUNDED' AS relation, amount FROM evs),
own AS (SELECT mint, funding_source AS src, creator AS dst, 'fund:' || creator AS key, 'FUNDED' AS relation, funding_amount AS amount FROM cf WHERE funding_source IS NOT NULL),
edges AS (SELECT mint, wallet AS src, mint::VARCHAR AS dst, CASE WHEN is_buy THEN 'buy:' ELSE 'sell:' END || signature AS key, CASE WHEN is_buy THEN 'BOUGHT' ELSE 'SOLD' END AS relation, amount FROM tr
 UNION ALL SELECT mint, creator, mint::VARCHAR, 'created', 'CREATED', NULL FROM launches UNION ALL SELECT * FROM own UNION ALL SELECT * FROM paid
 UNION ALL SELECT mint, s, d, 'fund:' || d, 'FUNDED', NULL FROM steps WHERE (mint, s, d) NOT IN (SELECT (mint, src, dst) FROM paid UNION SELECT (mint, src, dst) FROM own)
 UNION ALL SELECT mint, owner, mint::VARCHAR, 'holds:' || owner, 'HOLDS', NULL FROM held)"""


def edges(spark, sf):
    tape, _, creators, profiles, inflows, p, held = drawn(spark, sf)
    return G.graph_edges(tape, profiles, creators, inflows, p, held, told=True)


@query("graph_edges", "tape_c", "transfers", "entities", "launches", "holders", sql=f"WITH {DISPLAY}, {EDGES} SELECT mint, src, dst, key, relation, round(amount, 6) AS amount FROM edges")
def _(spark, sf):
    return edges(spark, sf).select("mint", "src", "dst", "key", "relation", F.round("amount", 6).alias("amount"))


@query("graph_simple_view", "tape_c", "transfers", "entities", "launches", "holders", sql=f"""WITH {DISPLAY}, {EDGES}
SELECT mint, least(src, dst) AS a, greatest(src, dst) AS b, round(sum(1 + log10(1.0::DOUBLE + coalesce(amount, 0))), 6) AS weight, array_to_string(list_sort(list(DISTINCT relation)), ',') AS relations FROM edges GROUP BY ALL""")
def _(spark, sf):
    return G.graph_simple_view(edges(spark, sf)).select("mint", "a", "b", F.round("weight", 6).alias("weight"), F.array_join("relations", ",").alias("relations"))


@query("graph_node_style", "holders", "entities", sql="""
SELECT mint, owner AS node, CASE WHEN entity_type IS NOT NULL THEN 'infrastructure' WHEN mint % 3 = 0 THEN 'holder' WHEN mint % 3 = 1 THEN 'funder' WHEN mint % 100 >= 75 THEN 'high_risk' WHEN mint % 100 >= 50 THEN 'suspicious' ELSE 'buyer' END AS category,
 round(least(1400.0::DOUBLE, 120 + 380 * log10(1.0::DOUBLE + greatest(0.0::DOUBLE, amount))), 6) AS size FROM holders LEFT JOIN entities ON address = owner""")
def _(spark, sf):
    known = B.entities(spark, sf).select(F.col("address").alias("owner"), "entity_type")
    role = F.when(F.col("mint") % 3 == 0, "holder").when(F.col("mint") % 3 == 1, "actor").otherwise("wallet")
    nodes = B.holders(spark, sf).join(known, "owner", "left").select("mint", F.col("owner").alias("node"), role.alias("role"), "entity_type", F.col("amount").alias("position"), (F.col("mint") % 100).alias("risk"))
    return G.graph_node_style(nodes).select("mint", "node", "category", F.round("size", 6).alias("size"))


# --- recurrence ------------------------------------------------------------------------------------------


def shaped_clusters(spark, sf):
    members = year_clusters(spark, sf).groupBy("mint", "cluster_id", "wallet").agg(F.lit(1).alias("x")).drop("x")
    sizes = X.cluster_sizes(members).filter("size >= 3")
    members = members.join(sizes.select("mint", "cluster_id"), ["mint", "cluster_id"], "left_semi")
    value = (F.col("mint") % 4) / 4.0 + 0.1
    clusters = sizes.select(
        "mint", "cluster_id", (F.col("mint") % 3 == 0).alias("has_funder"), (F.col("mint") % 2 == 0).alias("has_intermediary"),
        value.alias("buy_timing_similarity"), value.alias("buy_amount_similarity"), F.lit(0.9).alias("wallet_age_similarity"),
    )
    return H.cluster_fingerprints(clusters, members)


_RATIO = "CASE WHEN v >= 0.85::DOUBLE THEN 'very_high' WHEN v >= 0.6::DOUBLE THEN 'high' WHEN v >= 0.35::DOUBLE THEN 'medium' ELSE 'low' END"
SHAPED = f"""{FIRST}, {YEARS}, big AS (SELECT * FROM members JOIN sizes USING (mint, cluster_id) WHERE size >= 3),
shaped AS (SELECT mint, cluster_id, count(*) AS n, (mint % 4) / 4.0::DOUBLE + 0.1::DOUBLE AS v, list_sort(list(wallet)) AS ms FROM big GROUP BY ALL),
prints AS (SELECT mint, cluster_id, n, CASE WHEN n <= 3 THEN 'small' WHEN n <= 7 THEN 'medium' WHEN n <= 15 THEN 'large' ELSE 'very_large' END AS size_bucket,
 CASE WHEN mint % 6 = 0 THEN 'funder+intermediary' WHEN mint % 3 = 0 THEN 'single_funder' WHEN mint % 2 = 0 THEN 'intermediary' ELSE 'behavioural' END AS topology,
 {_RATIO} AS timing_bucket, {_RATIO} AS purchase_bucket, 'very_high' AS age_bucket, substr(sha256(array_to_string(ms, '|')), 1, 16) AS members_hash FROM shaped)"""


@query("cluster_fingerprints", "tape_c", sql=f"WITH {SHAPED} SELECT mint, cluster_id, size_bucket, topology, timing_bucket, purchase_bucket, age_bucket, members_hash FROM prints")
def _(spark, sf):
    return shaped_clusters(spark, sf).drop("members")


MATCHES = """both_ AS (SELECT x.mint, x.cluster_id, y.mint AS om, y.cluster_id AS oc, count(*) AS k FROM big x JOIN big y ON x.wallet = y.wallet AND x.mint <> y.mint GROUP BY ALL),
sim AS (SELECT b.mint, b.cluster_id, b.om, 0.6::DOUBLE * k / least(p.n, q.n) + 0.4::DOUBLE * (((p.size_bucket = q.size_bucket)::INT + (p.topology = q.topology)::INT + (p.timing_bucket = q.timing_bucket)::INT + (p.purchase_bucket = q.purchase_bucket)::INT + (p.age_bucket = q.age_bucket)::INT) / 5.0::DOUBLE) AS s
 FROM both_ b JOIN prints p ON p.mint = b.mint AND p.cluster_id = b.cluster_id JOIN prints q ON q.mint = b.om AND q.cluster_id = b.oc),
best AS (SELECT mint, cluster_id, om, max(s) AS s FROM sim WHERE s >= 0.6::DOUBLE - 1e-12::DOUBLE GROUP BY ALL)"""


@query("match_recurring", "tape_c", sql=f"""WITH {SHAPED}, {MATCHES}
SELECT mint, cluster_id, count(*) AS matches, round(max(s), 6) AS best_similarity, array_to_string(list(om ORDER BY round(s, 9) DESC, om)[1:10], ',') AS recurring_launches FROM best GROUP BY ALL""")
def _(spark, sf):
    prints = cut(shaped_clusters(spark, sf), "prints")
    out = H.match_recurring(prints, prints)
    return out.select("mint", "cluster_id", "matches", *r6("best_similarity"), F.array_join("recurring_launches", ",").alias("recurring_launches"))


# --- evidence -----------------------------------------------------------------------------------------------

LIST = "array_to_string(list_sort(list(DISTINCT m.wallet::VARCHAR)), ',')"


def shown(df):
    return df.select("mint", "cluster_id", "item", F.array_join("wallets", ",").alias("wallets"), F.round("strength", 6).alias("strength"))


def _grouped_sql(source, at_least, strength):
    return f"""SELECT m.mint, m.cluster_id, g.source::VARCHAR AS item, {LIST} AS wallets, round({strength}, 6)::DOUBLE AS strength
FROM members m JOIN {source} g ON g.mint = m.mint AND g.wallet = m.wallet GROUP BY m.mint, m.cluster_id, g.source HAVING count(DISTINCT m.wallet) >= {at_least}"""


ATOMIC_GROUPS = "atomic AS (SELECT DISTINCT mint, signature AS source, wallet FROM tape WHERE is_buy)"
SPONSOR_GROUPS = "sponsor AS (SELECT DISTINCT mint, fee_payer AS source, wallet FROM tape WHERE is_buy AND fee_payer <> wallet)"


@query("evidence_atomic", "tape_b", sql=f"WITH {CLUSTERS}, {ATOMIC_GROUPS} " + _grouped_sql("atomic", 2, "1.0"))
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    return shown(V.evidence_atomic(slot_clusters(tape).select("mint", "cluster_id", "wallet"), X.atomic_members(tape, None)))


@query("evidence_fee_payer", "tape_b", sql=f"WITH {CLUSTERS}, {SPONSOR_GROUPS} " + _grouped_sql("sponsor", 2, "0.85"))
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    members = slot_clusters(tape).select("mint", "cluster_id", "wallet")
    return shown(V.evidence_fee_payer(members, X.sponsor_members(tape, None), X.sponsor_signatures(tape, None)))


@query("evidence_common_funder", "tape_c", "transfers", "entities", sql=f"WITH {FUNDING}, {JUDGED}, {PRIVATE}, {YEARS} " + _grouped_sql("private", 2, "least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * count(DISTINCT m.wallet))"))
def _(spark, sf):
    f, _, _, private, _ = funder_groups(spark, sf)
    return shown(V.evidence_common_funder(year_clusters(spark, sf), private, f))


@query("evidence_infra_funder", "tape_c", "transfers", "entities", sql=f"WITH {FUNDING}, {JUDGED}, infra AS (SELECT f.mint, direct_funder AS source, f.wallet FROM funding f JOIN judged j ON j.mint = f.mint AND j.source = direct_funder WHERE kind <> 'FUNDER'), {YEARS} " + _grouped_sql("infra", 2, "0.15"))
def _(spark, sf):
    f, _, _, _, infra = funder_groups(spark, sf)
    return shown(V.evidence_infra_funder(year_clusters(spark, sf), infra, f))


@query("evidence_intermediary", "tape_c", "transfers", "entities", sql=f"WITH {PATHS}, allhops AS (SELECT DISTINCT mint, wallet, direct_funder AS source FROM paths), {YEARS} " + _grouped_sql("allhops", 3, "least(0.9::DOUBLE, 0.4::DOUBLE + 0.08::DOUBLE * count(DISTINCT m.wallet))"))
def _(spark, sf):
    p = paths(spark, sf)
    direct = p.select("mint", F.element_at("path", -2).alias("source"), "wallet").distinct()
    return shown(V.evidence_intermediary(year_clusters(spark, sf), direct))


def _over_sql(usable, having, strength):
    return f"""SELECT m.mint, m.cluster_id, NULL::VARCHAR AS item, {LIST} AS wallets, ({strength})::DOUBLE AS strength FROM members m JOIN facts f ON f.mint = m.mint AND f.wallet = m.wallet
WHERE {usable} GROUP BY m.mint, m.cluster_id HAVING count(*) >= 3 AND {having}"""


EV = f"WITH {FACTS}, {YEARS} "


@query("evidence_funding_window", "tape_c", "transfers", "wallet_tx", sql=EV + _over_sql("delay IS NOT NULL", "max(delay) <= 9000", "0.75"))
def _(spark, sf):
    return shown(V.evidence_funding_window(year_clusters(spark, sf), facts(spark, sf), 9000))


@query("evidence_entry_sync", "tape_c", "transfers", "wallet_tx", sql=EV + _over_sql("block_time <> 0", "max(block_time) - min(block_time) <= 6000", "CASE WHEN max(block_time) - min(block_time) <= 3000 THEN 0.7 ELSE 0.5 END"))
def _(spark, sf):
    return shown(V.evidence_entry_sync(year_clusters(spark, sf), facts(spark, sf), 6000, 3000))


@query("evidence_buy_size", "tape_c", "transfers", "wallet_tx", sql=EV + _over_sql("quote_amount > 0", "stddev_pop(quote_amount) / avg(quote_amount) <= 0.25::DOUBLE", "0.45"))
def _(spark, sf):
    return shown(V.evidence_buy_size(year_clusters(spark, sf), facts(spark, sf), 0.25))


@query("evidence_fresh", "tape_c", "transfers", "wallet_tx", sql=EV + _over_sql("age < 36000", "TRUE", "0.4"))
def _(spark, sf):
    return shown(V.evidence_fresh(year_clusters(spark, sf), facts(spark, sf), 36000))


@query("evidence_repeat", "tape_c", sql=f"""WITH {FIRST}, pr AS (SELECT DISTINCT mint AS other, wallet FROM tape), one AS (SELECT mint, 1 AS cluster_id, wallet FROM first_buys),
g AS (SELECT m.mint, m.cluster_id, other, {LIST} AS wallets, count(*) AS n FROM one m JOIN pr ON pr.wallet = m.wallet AND other <> m.mint GROUP BY ALL HAVING count(*) >= 3)
SELECT mint, cluster_id, other::VARCHAR AS item, wallets, round(least(0.9::DOUBLE, 0.45::DOUBLE + 0.1::DOUBLE * n), 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY mint, cluster_id ORDER BY n DESC, other) AS r FROM g) WHERE r <= 4""")
def _(spark, sf):
    tape = B.tape_c(spark, sf)
    early = T.first_buyers(tape, None)
    parts = W.participation(tape)
    members = early.select("mint", F.lit(1).alias("cluster_id"), "wallet")
    return shown(V.evidence_repeat(members, H.recurring_groups(early, parts), parts))


@query("evidence_creator", "tape_c", "transfers", "entities", "launches", sql=f"""WITH {PATHS}, {YEARS}, {LINKS}
SELECT m.mint, m.cluster_id, creator AS item, {LIST} AS wallets, 0.9::DOUBLE AS strength FROM members m JOIN links l ON l.mint = m.mint AND l.wallet = m.wallet GROUP BY m.mint, m.cluster_id, creator""")
def _(spark, sf):
    return shown(V.evidence_creator(year_clusters(spark, sf), links(spark, sf)))


@query("evidence_exit", "tape_b", sql=f"""WITH RECURSIVE {CLUSTERS}, {EXITS},
s AS (SELECT mint, cluster_id, wallet, first_sell_time AS t, row_number() OVER (PARTITION BY mint, cluster_id ORDER BY first_sell_time, wallet::VARCHAR) AS i
 FROM members JOIN exits USING (mint, wallet) WHERE exit_kind <> 'holding' AND first_sell_time IS NOT NULL),
walk AS (SELECT mint, cluster_id, i, wallet, t, t AS anchor, 1 AS g FROM s WHERE i = 1
 UNION ALL SELECT s.mint, s.cluster_id, s.i, s.wallet, s.t, CASE WHEN s.t - anchor > {120 * DAY} THEN s.t ELSE anchor END, CASE WHEN s.t - anchor > {120 * DAY} THEN g + 1 ELSE g END
 FROM walk w JOIN s ON s.mint = w.mint AND s.cluster_id = w.cluster_id AND s.i = w.i + 1),
gg AS (SELECT mint, cluster_id, g, count(*) AS n, array_to_string(list_sort(list(wallet::VARCHAR)), ',') AS wallets FROM walk GROUP BY ALL HAVING count(*) >= 3)
SELECT mint, cluster_id, NULL::VARCHAR AS item, wallets, 0.8::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY mint, cluster_id ORDER BY n DESC, g) AS r FROM gg) WHERE r = 1""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    return shown(V.evidence_exit(Z.sync_exit_groups(slot_clusters(tape), Z.wallet_exits(tape), 120 * DAY)))


@query("evidence_mayhem", "tape_l", "launches", sql="""
WITH a AS (SELECT mint, wallet, row_number() OVER (PARTITION BY mint ORDER BY wallet) AS r FROM (SELECT mint, wallet FROM tape GROUP BY ALL HAVING bool_and(mayhem))),
n AS (SELECT mint, array_to_string(list_sort(list(wallet::VARCHAR)), ',') AS w FROM a WHERE r <= 20 GROUP BY ALL),
e AS (SELECT mint FROM launches LEFT JOIN tape USING (mint) GROUP BY mint, is_mayhem HAVING is_mayhem OR bool_or(mayhem))
SELECT mint, 1 AS cluster_id, NULL::VARCHAR AS item, coalesce(w, '') AS wallets, 0.0::DOUBLE AS strength FROM e LEFT JOIN n USING (mint)""")
def _(spark, sf):
    tape, made = B.tape_l(spark, sf), B.launches(spark, sf)
    one = made.select("mint", F.lit(1).alias("cluster_id"))
    return shown(V.evidence_mayhem(one, T.mayhem_separation(tape, made), T.automated_wallets(tape)))


@query("evidence", "tape_b", sql=f"""WITH {CLUSTERS}, {ATOMIC_GROUPS}, {SPONSOR_GROUPS},
e AS (SELECT *, 'ATOMIC_EXECUTION' AS code, 0 AS o FROM ({_grouped_sql('atomic', 2, '1.0')}) UNION ALL SELECT *, 'SHARED_FEE_PAYER', 1 FROM ({_grouped_sql('sponsor', 2, '0.85')}))
SELECT mint, cluster_id, code, item, wallets, strength, TRUE AS traceable, row_number() OVER (PARTITION BY mint, cluster_id ORDER BY strength DESC, o, item)::INT AS rank FROM e""")
def _(spark, sf):
    tape = B.tape_b(spark, sf)
    members = slot_clusters(tape).select("mint", "cluster_id", "wallet")
    parts = [V.evidence_atomic(members, X.atomic_members(tape, None)), V.evidence_fee_payer(members, X.sponsor_members(tape, None), X.sponsor_signatures(tape, None))]
    out = V.evidence(parts)
    return out.select("mint", "cluster_id", "code", "item", F.array_join("wallets", ",").alias("wallets"), "strength", "traceable", "rank")
