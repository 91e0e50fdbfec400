"""The wallet graph: typed nodes and edges for display, and weighted associations for clustering."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators import launchwise as L
from mintweave.operators.skew import HEAVY, heavy_keys, last_before
from mintweave.session import cut
from mintweave.sources.schemas import TAPE_ORDER


def funding_events(first_buys: DataFrame, transfers: DataFrame, n: int = 3, width: int = 86400, heavy: int = HEAVY) -> DataFrame:
    """The newest ``n`` inflows before each first buy, newest first (``event`` = 1..n), a row each."""
    found = wallet_inflows(first_buys, transfers, n, width, heavy)
    return found.select("mint", "wallet", F.posexplode("inflows").alias("_i", "_h")).select("mint", "wallet", "_h.*", (F.col("_i") + 1).alias("event"))


def wallet_inflows(first_buys: DataFrame, transfers: DataFrame, n: int = 3, width: int = 86400, heavy: int = HEAVY) -> DataFrame:
    """The newest ``n`` inflows before each first buy as one row per (mint, wallet): ``inflows``, newest first.

    One exchange and one ordered pass per wallet give all ``n``.  Only wallets of
    more than ``heavy`` rows take one bucketed as-of join per event.
    """
    order, ties = ["block_time", "slot"], ["signature", "source"]
    rows = transfers.select(F.col("recipient").alias("wallet"), *order, *ties, "amount")
    buys = cut(first_buys.select("mint", "wallet", *order), "buys")
    large = heavy_keys(buys, rows, "wallet", heavy)
    if large.isEmpty():
        return _newest_inflows(buys, rows, n)
    some = {k: [df.join(large, "wallet", k) for df in (buys, rows)] for k in ("left_anti", "left_semi")}
    # the chain is left to the one pass wherever a task can order the wallet
    return _newest_inflows(*some["left_anti"], n).unionByName(_chained_inflows(*some["left_semi"], n, width))


def _newest_inflows(buys: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    c = F.col
    key = ["block_time", "slot", "signature", "source"]
    both = buys.withColumn("_kind", F.lit(0)).unionByName(rows.filter(c("wallet").isNotNull()).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("wallet").orderBy("block_time", "slot", "_kind", "signature", "source", "amount")
    # of rows with one key the last, with the largest amount, stands for all
    later = F.lead(F.struct(*key, "_kind")).over(w)
    event = F.when((c("_kind") == 1) & ~later.eqNullSafe(F.struct(*key, "_kind")), F.struct(*key, "amount"))
    newest = F.array(*[F.expr(f"lag(_event, {k}) IGNORE NULLS OVER (PARTITION BY wallet ORDER BY block_time, slot, _kind, signature, source, amount)") for k in range(1, n + 1)])
    hits = both.withColumn("_event", event).withColumn("inflows", F.array_compact(newest)).filter("_kind = 0 and wallet is not null")
    return hits.select("mint", "wallet", "inflows").filter(F.size("inflows") > 0)


def _chained_inflows(buys: DataFrame, rows: DataFrame, n: int, width: int) -> DataFrame:
    order, ties = ["block_time", "slot"], ["signature", "source"]
    full = [*order, *ties]
    payload = [*full, "amount"]
    head = last_before(buys, rows, on="wallet", order=order, ties=[*ties, "amount"], payload=payload, width=width, heavy=0)
    found = head.filter("hit is not null").select("mint", "wallet", "hit.*", F.lit(1).alias("event"))
    out = found
    for k in range(2, n + 1):
        found = cut(found, "inflow")
        step = last_before(found.select("mint", "wallet", *full), rows, on="wallet", order=full, ties=["amount"], payload=payload, width=width, heavy=0)
        found = step.filter("hit is not null").select("mint", "wallet", "hit.*", F.lit(k).alias("event"))
        out = out.unionByName(found)
    listed = out.groupBy("mint", "wallet").agg(F.array_sort(F.collect_list(F.struct("event", F.struct(*payload).alias("_h")))).alias("_l"))
    return listed.select("mint", "wallet", F.transform("_l", lambda x: x["_h"]).alias("inflows"))


def newest_funder(inflows: DataFrame) -> DataFrame:
    """The newest inflow as the funding of a first buy: what ``funding_paths`` starts from, without another as-of join."""
    top = F.col("inflows")[0]
    return inflows.select(
        "mint", "wallet", top["source"].alias("direct_funder"), top["amount"].alias("funding_amount"), top["block_time"].alias("funding_time"), top["slot"].alias("funding_slot")
    )


def graph_nodes(
    launches: DataFrame, profiles: DataFrame, creators: DataFrame, actors: DataFrame, holders: DataFrame
) -> DataFrame:
    """One row per (mint, node).

    Buyers keep their attributes, the creator's type, label and risk replace a
    buyer's, funders and path nodes come in only where nothing else is known,
    and a top holder that is no buyer is restated as a holder.
    """
    text, none = "string", F.lit(None)

    def rows(df, node, prio, role, entity, label, balance=none, position=none, age=none, risk=none):
        return df.select(
            "mint", node.cast(text).alias("node"), F.lit(prio).alias("_p"), F.lit(role).alias("role"), entity.alias("entity_type"),
            label.cast(text).alias("label"), balance.cast("double").alias("sol_balance"), position.cast("double").alias("position"),
            age.cast("double").alias("age_seconds"), risk.cast("int").alias("risk"),
        )

    c = F.col
    owners = holders.join(profiles.select("mint", c("wallet").alias("owner")), ["mint", "owner"], "left_anti")
    parts = [
        rows(launches, c("mint"), 9, "token", F.lit("TOKEN"), c("mint")),
        rows(profiles, c("wallet"), 2, "wallet", c("entity_type"), c("label"), c("sol_balance"), c("token_position"), c("age_seconds"), c("risk_score")),
        rows(creators, c("creator"), 3, "wallet", F.lit("CREATOR"), F.lit("creator"), risk=c("creator_risk")),
        rows(actors, c("address"), 1, "actor", c("entity_type"), c("label")),
        rows(owners, c("owner"), 4, "holder", F.lit("UNKNOWN"), none, position=c("amount")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    top = F.max_by(F.struct("role", "entity_type", "label"), "_p")
    return every.groupBy("mint", "node").agg(
        top.alias("_t"),
        F.max_by("risk", F.when(c("risk").isNotNull(), c("_p"))).alias("risk"),
        F.max_by("position", F.when(c("position").isNotNull(), c("_p"))).alias("position"),
        F.max("sol_balance").alias("sol_balance"),
        F.max("age_seconds").alias("age_seconds"),
    ).select("mint", "node", "_t.*", "sol_balance", "position", "age_seconds", "risk")


RELATIONS = ("BOUGHT", "CREATED", "FUNDED", "HOLDS", "SOLD")


def graph_edges(
    trades: DataFrame, profiles: DataFrame, creators: DataFrame, inflows: DataFrame, paths: DataFrame, holders: DataFrame, told: bool = False
) -> DataFrame:
    """Typed directed edges; ``key`` keeps parallel edges apart and one transaction once per pair.

    ``inflows``: ``wallet_inflows``.  ``told``: every path's last step, into the buyer, is among that buyer's
    inflows (as with paths made from ``newest_funder``), so it needs no look-up.
    """
    c = F.col

    def edge(df, src, dst, key, relation, amount=F.lit(None), signature=F.lit(None), time=F.lit(None)):
        return df.select(
            "mint", src.cast("string").alias("src"), dst.cast("string").alias("dst"), key.alias("key"), F.lit(relation).alias("relation")
            if isinstance(relation, str) else relation.alias("relation"),
            amount.cast("double").alias("amount"), signature.cast("string").alias("signature"), time.cast("long").alias("block_time"),
        )

    who = profiles.select("mint", "wallet")
    side = F.when(c("is_buy"), "buy").otherwise("sell")
    last = F.max(F.struct(*[n for n in TAPE_ORDER if n not in ("wallet", "signature")])).alias("_l")
    traded = (
        trades.join(who, ["mint", "wallet"], "left_semi")
        .groupBy("mint", "wallet", "signature", side.alias("_side"))
        .agg(last)
    )
    trade_edges = edge(
        traded, c("wallet"), c("mint"), F.concat_ws(":", "_side", c("signature").cast("string")),
        F.when(c("_side") == "buy", "BOUGHT").otherwise("SOLD"), c("_l.quote_amount"), c("signature"), c("_l.block_time"),
    )
    created = edge(creators, c("creator"), c("mint"), F.lit("created"), "CREATED")
    own = edge(
        creators.filter("funding_source is not null"), c("funding_source"), c("creator"), F.concat(F.lit("fund:"), c("creator")),
        "FUNDED", c("funding_amount"),
    )

    def again(x, i):
        """An earlier listed inflow has the same source and transaction."""
        return F.exists(F.slice("inflows", F.lit(1), i), lambda y: (y["source"] == x["source"]) & y["signature"].eqNullSafe(x["signature"]))

    # a transaction counts once per pair, and all of a pair's inflows lie in one row
    once = F.filter("inflows", lambda x, i: x["source"].isNotNull() & ~again(x, i))
    sent = inflows.select("mint", "wallet", F.explode(once).alias("_h"))
    paid = edge(
        sent, c("_h.source"), c("wallet"), F.concat(F.lit("fund:"), c("_h.signature").cast("string")), "FUNDED", c("_h.amount"), c("_h.signature"),
    )
    steps = (
        paths.select("mint", "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("_i"))
        .filter(c("_i") < F.size("path") - 1 if told else F.lit(True))
        .select("mint", F.element_at("path", c("_i")).alias("_s"), F.element_at("path", c("_i") + 1).alias("_d"))
        .filter("_s <> _d")
        .distinct()
    )
    known = own.select("mint", c("src").alias("_s"), c("dst").alias("_d"))
    # only steps into a buyer can be among the payments; mostly that is few of them or none
    doubtful = cut(steps.join(who.select("mint", c("wallet").alias("_d")), ["mint", "_d"], "left_semi"), "doubtful")
    if not doubtful.isEmpty():
        known = known.unionByName(paid.select("mint", c("src").alias("_s"), c("dst").alias("_d")).join(doubtful, ["mint", "_s", "_d"], "left_semi"))
    hops = edge(steps.join(known.distinct(), ["mint", "_s", "_d"], "left_anti"), c("_s"), c("_d"), F.concat(F.lit("fund:"), c("_d")), "FUNDED")
    owners = holders.join(profiles.select("mint", c("wallet").alias("owner")), ["mint", "owner"], "left_anti")
    held = edge(owners, c("owner"), c("mint"), F.concat(F.lit("holds:"), c("owner")), "HOLDS")
    return trade_edges.unionByName(created).unionByName(own).unionByName(paid).unionByName(hops).unionByName(held)


def graph_simple_view(edges: DataFrame) -> DataFrame:
    """Undirected view: summed log weights and the set of relations per pair.

    The relations travel as bits of one number, in the order of their names.
    """
    weight = 1.0 + F.log10(1.0 + F.coalesce("amount", F.lit(0.0)))
    bit = F.lit(None)
    for i, name in enumerate(RELATIONS):
        bit = F.when(F.col("relation") == name, 1 << i).otherwise(bit)
    unknown = F.col("relation").isNotNull() & bit.isNull()
    bit = F.when(unknown, F.raise_error(F.concat(F.lit("unknown relation "), "relation"))).otherwise(bit)
    pairs = edges.groupBy("mint", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(weight).alias("weight"), F.coalesce(F.bit_or(bit), F.lit(0)).alias("_bits")
    )
    names = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(RELATIONS)]))
    return pairs.select("mint", "a", "b", "weight", names.alias("relations"))


def graph_node_style(nodes: DataFrame, size_by: str = "position") -> DataFrame:
    magnitude = {"position": F.col("position"), "sol": F.col("sol_balance")}.get(size_by, F.lit(1.0))
    size = F.when(F.col("role") == "token", 900.0).otherwise(S.node_size(F.coalesce(magnitude, F.lit(0.0))))
    return nodes.withColumn("category", S.node_category(F.col("role"), F.col("entity_type"), F.col("risk"))).withColumn("size", size)


def group_pairs(members: DataFrame) -> DataFrame:
    """Wallet pairs of each (mint, source) group with the group's size.

    The groups hold early buyers of one launch, so the buyer limit (100 at most)
    bounds the pairs of a group, and infrastructure sources are left out before.
    """
    sorted_group = F.array_sort(F.collect_set("wallet"))
    groups = members.groupBy("mint", "source", "weight").agg(sorted_group.alias("_w")).filter(F.size("_w") > 1)
    return groups.select("mint", "source", "weight", F.size("_w").alias("n"), "_w", F.posexplode("_w").alias("_i", "src")).select(
        "mint", "source", "weight", "n", "src", F.explode(F.slice("_w", F.col("_i") + 2, F.col("n"))).alias("dst")
    )


def assoc_edges(
    private_funders: DataFrame, private_hops: DataFrame, funding: DataFrame, profiles: DataFrame, overlaps: DataFrame | None = None
) -> DataFrame:
    """Weighted undirected associations between a launch's buyers.

    ``private_funders`` / ``private_hops``: (mint, source, wallet, weight) without
    infrastructure; a hop that is somebody's direct funder counts as funder only.
    """
    c = F.col

    def shared(members, base, relation):
        per_pair = F.lit(base) * c("weight") / F.greatest(F.lit(1.0), F.sqrt(c("n") - F.lit(1.0)))
        return group_pairs(members).select(
            "mint", "src", "dst", per_pair.alias("weight"), F.lit(relation).alias("relation"), c("source").cast("string").alias("via")
        )

    who = profiles.select("mint", "wallet")
    sent = (
        funding.filter("direct_funder is not null and direct_funder <> wallet")
        .join(who.withColumnRenamed("wallet", "direct_funder"), ["mint", "direct_funder"], "left_semi")
        .select(
            "mint", F.least("direct_funder", "wallet").alias("src"), F.greatest("direct_funder", "wallet").alias("dst"),
            F.lit(P.WEIGHT_TRANSFER).alias("weight"), F.lit("FUNDED").alias("relation"), c("direct_funder").alias("via"),
        )
    )
    parts = shared(private_funders, P.WEIGHT_FUNDER, "COMMON_FUNDER").unionByName(
        shared(private_hops, P.WEIGHT_INTERMEDIARY, "COMMON_INTERMEDIARY")
    ).unionByName(sent)
    if overlaps is not None:
        parts = parts.unionByName(
            overlaps.filter("overlap > 0").select(
                "mint", c("a").alias("src"), c("b").alias("dst"), (P.WEIGHT_HISTORY * c("overlap")).alias("weight"),
                F.lit("COMMON_LAUNCH").alias("relation"), F.lit("history").alias("via"),
            )
        )
    marks = F.array_sort(F.collect_list(F.struct("relation", "via")))
    return parts.filter("weight > 0").groupBy("mint", "src", "dst").agg(F.sum("weight").alias("weight"), marks.alias("_m")).select(
        "mint", "src", "dst", "weight", F.transform("_m", lambda x: x["relation"]).alias("relations"), F.transform("_m", lambda x: x["via"]).alias("vias")
    )


def star_links(members: DataFrame) -> DataFrame:
    """The links of each group to its lowest wallet: same components as all pairs, linear in size."""
    low = members.groupBy("mint", "source").agg(F.min("wallet").alias("dst"))
    return members.select("mint", "source", F.col("wallet").alias("src")).join(low, ["mint", "source"]).filter("src <> dst").select("mint", "src", "dst")


def connected_components(edges: DataFrame, max_rounds: int = 60, local: int = L.LOCAL) -> DataFrame:
    """Components of all launches' graphs at once: ``mint, wallet, component`` (lowest member).

    Launches of up to ``local`` edges are each settled inside a task, after one exchange;
    only larger ones take rounds of joins.
    """
    links = cut(edges.select("mint", "src", "dst").filter("src <> dst and mint is not null"), "links")
    kinds = dict(links.dtypes)
    found, large = L.by_launch(links, L.components, f"mint {kinds['mint']}, wallet {kinds['src']}, component {kinds['src']}", local)
    return found if large is None else found.unionByName(_components_in_rounds(large, max_rounds))


def group_components(members: DataFrame, local: int = L.LOCAL) -> DataFrame:
    """Components of launches whose groups (mint, source, wallet) link all their members, without a table of links."""
    rows = cut(members.select("mint", "source", "wallet").filter("mint is not null and source is not null and wallet is not null"), "members")
    kinds = dict(rows.dtypes)
    found, large = L.by_launch(rows, L.group_components, f"mint {kinds['mint']}, wallet {kinds['wallet']}, component {kinds['wallet']}", local)
    return found if large is None else found.unionByName(_components_in_rounds(star_links(cut(large, "members")), 60))


def _components_in_rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Alternating large-star and small-star steps (Kiveris et al. 2014).

    They run over numbers that keep the order of (mint, wallet): names are read before the
    first and after the last round only.  Every step is a grouped minimum and a
    join on a node, so a hub is split by the engine's skew join and no
    neighbourhood is ever collected.  The join hashes the minima, one row a node,
    so a task sorts no edges.
    """
    c = F.col
    links = cut(edges.select("mint", F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "links")
    ends = links.select("mint", c("src").alias("wallet")).unionByName(links.select("mint", c("dst").alias("wallet"))).distinct()
    # written with the numbers: a sort that ran twice could number anew
    nodes = cut(ends.orderBy("mint", "wallet").withColumn("id", F.monotonically_increasing_id()), "nodes")
    for end, number in (("src", "u"), ("dst", "v")):
        links = links.join(nodes.select("mint", c("wallet").alias(end), c("id").alias(number)), ["mint", end]).drop(end)
    state = cut(links.select("u", "v"), "stars")
    mark = None
    for _ in range(max_rounds):
        state = cut(_small_star(_large_star(state)), "stars")
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    placed = state.unionByName(state.select(c("v").alias("u"), "v").distinct())
    roots = nodes.select(c("id").alias("v"), c("wallet").alias("component")).join(state.select("v").distinct(), "v")
    return nodes.withColumnRenamed("id", "u").join(placed, "u").join(roots, "v").select("mint", "wallet", "component")


def _large_star(state: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest one around it."""
    ends = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = ends.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return ends.filter("v > u").join(low.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(state: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    low = state.groupBy("u").agg(F.min("v").alias("_m"))
    moved = state.join(low.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v")
    return moved.unionByName(low.select("u", F.col("_m").alias("v"))).distinct()


def _weighted(edges: DataFrame) -> DataFrame:
    return cut(edges.select("mint", "src", "dst", "weight").filter("mint is not null"), "weights")


def communities(edges: DataFrame, local: int = L.LOCAL) -> DataFrame:
    """Modularity communities of every launch's weighted graph: ``mint, wallet, community``.

    Greedy agglomeration: each round every community names the merge
    with the largest modularity gain and mutual choices are merged.  Disjoint
    merges add up, so modularity only grows; ties go to the lowest pair, so the
    result is deterministic.  Stops when no merge gains; every round merges at
    least the pair with the largest gain, so it ends.  Launches of up to ``local``
    edges take their rounds inside a task, larger ones by joins.
    """
    links = _weighted(edges)
    kinds = dict(links.dtypes)
    found, large = L.by_launch(links, L.communities, f"mint {kinds['mint']}, wallet {kinds['src']}, community {kinds['src']}", local)
    return found if large is None else found.unionByName(_communities_in_rounds(cut(large, "weights")))


def community_modularity(edges: DataFrame, local: int = L.LOCAL) -> DataFrame:
    """Modularity of each launch's communities, without a table of them where a task settles the launch."""
    links = _weighted(edges)
    found, large = L.by_launch(links, L.modularity, f"mint {dict(links.dtypes)['mint']}, modularity double", local)
    if large is None:
        return found
    large = cut(large, "weights")
    return found.unionByName(modularity(large, _communities_in_rounds(large)))


def _communities_in_rounds(edges: DataFrame) -> DataFrame:
    pairs = edges.select("mint", "src", "dst", "weight")
    total = cut(pairs.groupBy("mint").agg(F.sum("weight").alias("m")), "weights")
    ends = pairs.select("mint", F.col("src").alias("c"), "weight").unionByName(pairs.select("mint", F.col("dst").alias("c"), "weight"))
    degree = cut(ends.groupBy("mint", "c").agg(F.sum("weight").alias("k")), "weights")
    links = cut(pairs.select("mint", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w")), "weights")
    label = degree.select("mint", F.col("c").alias("wallet"), F.col("c").alias("community"))
    while True:
        ka, kb = (degree.select("mint", F.col("c").alias(x), F.col("k").alias(f"k{x}")) for x in ("a", "b"))
        gain = F.col("w") / F.col("m") - F.col("ka") * F.col("kb") / (2 * F.col("m") * F.col("m"))
        gains = links.join(total, "mint").join(ka, ["mint", "a"]).join(kb, ["mint", "b"]).withColumn("g", gain).filter("g > 1e-12")
        choice = F.struct((-F.round("g", 12)).alias("g"), F.col("a").alias("a"), F.col("b").alias("b"))
        votes = gains.select("mint", F.col("a").alias("c"), choice.alias("x")).unionByName(gains.select("mint", F.col("b").alias("c"), choice.alias("x")))
        best = votes.groupBy("mint", "c").agg(F.min("x").alias("x"))
        merges = cut(
            best.groupBy("mint", F.col("x.a").alias("keep"), F.col("x.b").alias("gone")).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n"),
            "merges",
        )
        if merges.isEmpty():
            break
        moved = merges.select("mint", F.col("gone").alias("c"), "keep")

        def renamed(df, column):
            return df.join(moved.withColumnRenamed("c", column), ["mint", column], "left").withColumn(column, F.coalesce("keep", column)).drop("keep")

        label = cut(renamed(label, "community"), "labels")
        degree = cut(renamed(degree, "c").groupBy("mint", "c").agg(F.sum("k").alias("k")), "weights")
        links = renamed(renamed(links, "a"), "b").filter("a <> b")
        links = cut(
            links.groupBy("mint", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "weights"
        )
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition, per launch."""
    a = labels.select("mint", F.col("wallet").alias("src"), F.col("community").alias("ca"))
    b = labels.select("mint", F.col("wallet").alias("dst"), F.col("community").alias("cb"))
    placed = edges.select("mint", "src", "dst", "weight").join(a, ["mint", "src"]).join(b, ["mint", "dst"])
    inside = F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0))
    total = placed.groupBy("mint").agg(F.sum("weight").alias("m"), inside.alias("inside"))
    ends = placed.select("mint", F.col("ca").alias("c"), "weight").unionByName(placed.select("mint", F.col("cb").alias("c"), "weight"))
    square = ends.groupBy("mint", "c").agg(F.sum("weight").alias("k")).groupBy("mint").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.join(square, "mint").select(
        "mint", (F.col("inside") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity")
    )


FEATURES = ["f0", "f1", "f2", "f3", "f4"]


def behaviour_features(profiles: DataFrame) -> DataFrame:
    """Log features standardised per launch (population deviation; a constant feature keeps scale 1)."""
    c = F.col
    raw = S.log_features(c("seconds_after_launch"), c("quote_amount"), c("funding_amount"), c("funding_to_buy_seconds"), c("age_seconds"))
    # written once: the statistics and the scaling both read it, and making it reads the tape and the transfers
    rows = cut(profiles.filter("seconds_after_launch is not null").select("mint", "wallet", "position", *[f.alias(n) for f, n in zip(raw, FEATURES)]), "features")
    stats = rows.groupBy("mint").agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"_m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"_s_{f}") for f in FEATURES]
    )
    scaled = [
        ((c(f) - c(f"_m_{f}")) / F.when(c(f"_s_{f}") > 1e-12, c(f"_s_{f}")).otherwise(1.0)).alias(f) for f in FEATURES
    ]
    return rows.join(stats, "mint").filter(c("_n") >= P.DENSITY_MIN_POINTS).select("mint", "wallet", "position", *scaled)


def behaviour_neighbours(features: DataFrame, eps: float = P.DENSITY_EPS, crowded: int = 1000) -> DataFrame:
    """Ordered pairs of a launch's buyers within ``eps``; launches of more than ``crowded`` buyers meet in grid cells of that width."""
    c = F.col
    distance = sum(((c(f"a_{f}") - c(f"b_{f}")) * (c(f"a_{f}") - c(f"b_{f}")) for f in FEATURES), F.lit(0.0))

    def pairs(left, right, on):
        a = left.select(*on, c("wallet").alias("a"), *[c(f).alias(f"a_{f}") for f in FEATURES])
        b = right.select(*on, c("wallet").alias("b"), *[c(f).alias(f"b_{f}") for f in FEATURES])
        return a.join(b, on).filter(distance <= eps * eps).select("mint", "a", "b")

    # A launch of few buyers is compared whole: nine copies of each buyer, one per cell, would cross the shuffle for nothing.
    large = cut(features.groupBy("mint").agg(F.count(F.lit(1)).alias("_n")).filter(c("_n") > crowded).select("mint"), "crowded")
    if large.isEmpty():
        return pairs(features, features, ["mint"])
    few = features.join(large, "mint", "left_anti")
    cell = features.join(large, "mint", "left_semi").withColumn("_x", F.floor(c("f0") / eps)).withColumn("_y", F.floor(c("f1") / eps))
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = cell.withColumn("_d", F.explode(near)).withColumn("_x", c("_x") + c("_d.dx")).withColumn("_y", c("_y") + c("_d.dy"))
    return pairs(few, few, ["mint"]).unionByName(pairs(around, cell, ["mint", "_x", "_y"]))


def behaviour_groups(features: DataFrame, eps: float = P.DENSITY_EPS, min_points: int = P.DENSITY_MIN_POINTS, crowded: int = 1000) -> DataFrame:
    """Density clusters: ``mint, wallet, group, is_core``.

    Cores joined by components over core pairs; a border point goes to the
    adjacent cluster whose first core (by first-buy position) comes first.
    Launches of up to ``crowded`` buyers are compared and settled inside a task,
    so their pairs never become rows of a table.
    """
    rows = features.select("mint", "wallet", "position", *FEATURES).filter("mint is not null")
    kinds = dict(rows.dtypes)
    found, large = L.by_launch(
        rows, partial(L.density_groups, features=FEATURES, eps=eps, min_points=min_points),
        f"mint {kinds['mint']}, wallet {kinds['wallet']}, group {kinds['wallet']}, is_core boolean", crowded,
    )
    return found if large is None else found.unionByName(_groups_by_joins(large, eps, min_points))


def _groups_by_joins(features: DataFrame, eps: float, min_points: int) -> DataFrame:
    near = cut(behaviour_neighbours(features, eps), "near")
    core = cut(near.groupBy("mint", "a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select("mint", "a"), "core")
    core_b = core.withColumnRenamed("a", "b")
    links = near.join(core, ["mint", "a"], "left_semi").join(core_b, ["mint", "b"], "left_semi").filter("a < b")
    parts = connected_components(links.select("mint", F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = core.withColumnRenamed("a", "wallet").join(parts, ["mint", "wallet"], "left").withColumn("component", F.coalesce("component", "wallet"))
    first = placed.join(features.select("mint", "wallet", "position"), ["mint", "wallet"]).groupBy("mint", "component").agg(F.min("position").alias("first"))
    placed = placed.join(first, ["mint", "component"])
    border = (
        near.join(core, ["mint", "a"], "left_anti")
        .join(placed.withColumnRenamed("wallet", "b"), ["mint", "b"])
        .groupBy("mint", F.col("a").alias("wallet"))
        .agg(F.min_by("component", "first").alias("component"))
        .withColumn("is_core", F.lit(False))
    )
    return placed.select("mint", "wallet", "component").withColumn("is_core", F.lit(True)).unionByName(border).withColumnRenamed("component", "group")
