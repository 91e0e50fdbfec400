"""From candidate groups to clusters and their signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators.execution import best_shared_share, cluster_sizes, execution_strength

KEYS = ["mint", "cluster_id"]
# Order in which equally large proposals are considered.
METHODS = ("graph", "execution", "community", "behaviour")


def candidates(groups: dict[str, DataFrame], profiles: DataFrame | None = None) -> DataFrame:
    """Proposals of every method as rows (mint, method, rank, members).

    ``groups``: name -> (mint, source, wallet); names ``graph``, ``sponsor``,
    ``atomic``, ``community``, ``behaviour``.  Only profiled wallets count, so
    the early-buyer limit bounds every member list.
    """
    ranks = {"graph": (0, "graph"), "sponsor": (1, "execution"), "atomic": (2, "execution"), "community": (3, "community"), "behaviour": (4, "behaviour")}
    out = None
    for name, rows in groups.items():
        rank, method = ranks[name]
        kept = rows if profiles is None else rows.join(profiles.select("mint", "wallet"), ["mint", "wallet"], "left_semi")
        part = (
            kept.groupBy("mint", F.col("source").cast("string").alias("source"))
            .agg(F.array_sort(F.collect_set(F.col("wallet").cast("string"))).alias("members"))
            .filter(F.size("members") >= 2)
            .select("mint", F.lit(rank).alias("rank"), F.lit(method).alias("method"), "members")
        )
        out = part if out is None else out.unionByName(part)
    return out


def merge_candidates(proposals: DataFrame, threshold: float = P.MERGE_JACCARD) -> DataFrame:
    """Fold each launch's proposals, largest first, into merged groups (mint, order, members, methods).

    A proposal joins the first group it overlaps enough (members and methods) or
    lies inside of (methods only).  The fold is sequential within a launch, whose
    proposals the buyer limit bounds, and parallel over launches.
    """
    listed = proposals.groupBy("mint").agg(
        F.array_sort(F.collect_list(F.struct((-F.size("members")).alias("k"), "rank", "members", "method"))).alias("_p")
    )
    kind = "array<struct<members:array<string>,methods:array<string>>>"

    def step(acc, p):
        def joins(e):
            return S.jaccard(p["members"], e["members"]) >= threshold

        def inside(e):
            return F.size(F.array_except(p["members"], e["members"])) == 0

        at = F.array_position(F.transform(acc, lambda e: joins(e) | inside(e)), F.lit(True))

        def absorb(e, i):
            members = F.when(joins(e), F.array_sort(F.array_union(e["members"], p["members"]))).otherwise(e["members"])
            merged = F.struct(members.alias("members"), F.array_sort(F.array_union(e["methods"], F.array(p["method"]))).alias("methods"))
            return F.when(i == at - 1, merged).otherwise(e)

        fresh = F.struct(p["members"].alias("members"), F.array(p["method"]).alias("methods"))
        return F.when(at > 0, F.transform(acc, absorb)).otherwise(F.array_append(acc, fresh))

    empty = F.from_json(F.lit("[]"), kind)
    folded = listed.select("mint", F.posexplode(F.aggregate("_p", empty, step)).alias("order", "_g"))
    return folded.select("mint", "order", "_g.members", "_g.methods")


def build_clusters(merged: DataFrame, min_size: int = P.MIN_CLUSTER_SIZE) -> DataFrame:
    """Numbered clusters, largest first: ``mint, cluster_id, size, method, members``."""
    w = Window.partitionBy("mint").orderBy(F.size("members").desc(), "order")
    return (
        merged.filter(F.size("members") >= min_size)
        .withColumn("cluster_id", F.row_number().over(w))
        .select(*KEYS, F.size("members").alias("size"), F.array_join("methods", "+").alias("method"), "members")
    )


def cluster_members(clusters: DataFrame) -> DataFrame:
    return clusters.select(*KEYS, F.explode("members").alias("wallet"))


def wallet_cluster(members: DataFrame) -> DataFrame:
    """The last cluster that contains each wallet."""
    return members.groupBy("mint", "wallet").agg(F.max("cluster_id").alias("cluster_id"))


def common_sources(members: DataFrame, groups: DataFrame, at_least: int = 2) -> DataFrame:
    """Sources that reach ``at_least`` members of a cluster, with how many."""
    return (
        members.join(groups.select("mint", "source", "wallet"), ["mint", "wallet"])
        .groupBy(*KEYS, "source")
        .agg(F.count(F.lit(1)).alias("wallets"))
        .filter(F.col("wallets") >= at_least)
    )


def top_cluster(clusters: DataFrame, score: str = "score") -> DataFrame:
    """Largest cluster per launch; higher score, then lower id, break ties."""
    best = F.max(F.struct("size", F.col(score).alias("s"), (-F.col("cluster_id")).alias("i")))
    return clusters.groupBy("mint").agg(best.alias("_b")).select("mint", (-F.col("_b.i")).alias("cluster_id"), F.col("_b.size").alias("size"))


SIGNALS = [*P.SIGNALS, *P.UNWEIGHTED_SIGNALS]


def measured_similarities(members: DataFrame, facts: DataFrame) -> DataFrame:
    """The five amount, timing and age similarities of each cluster.

    ``facts`` (mint, wallet): funding_amount, funding_time, quote_amount, block_time, age_seconds.
    """
    c = F.col
    rows = members.join(facts, ["mint", "wallet"])
    return rows.groupBy(*KEYS).agg(
        S.amount_similarity(S.known(c("funding_amount"))).alias("funding_amount_similarity"),
        S.timing_similarity(S.known(c("funding_time")), P.FUNDING_WINDOW).alias("funding_timing_similarity"),
        S.amount_similarity(F.when(c("quote_amount") > 0, c("quote_amount"))).alias("buy_amount_similarity"),
        S.timing_similarity(S.known(c("block_time")), P.BUY_WINDOW).alias("buy_timing_similarity"),
        S.amount_similarity(c("age_seconds"), P.AGE_CV_IDENTICAL, P.AGE_CV_UNRELATED).alias("wallet_age_similarity"),
    )


def historical_overlap(members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Mean pairwise history overlap of a cluster; pairs without overlap count as zero."""
    a = members.select(*KEYS, F.col("wallet").alias("a"))
    b = members.select(*KEYS, F.col("wallet").alias("b"))
    found = overlaps.select("mint", "a", "b", "overlap").join(a, ["mint", "a"]).join(b, [*KEYS, "b"]).groupBy(*KEYS).agg(F.sum("overlap").alias("_sum"))
    n = F.col("size")
    return cluster_sizes(members).join(found, KEYS, "left").select(
        *KEYS, F.when(n > 1, F.coalesce("_sum", F.lit(0.0)) / (n * (n - 1) / 2.0)).otherwise(0.0).alias("historical_overlap")
    )


def linked_share(members: DataFrame, links: DataFrame) -> DataFrame:
    hit = members.join(links.select("mint", "wallet").distinct(), ["mint", "wallet"], "left_semi").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_k"))
    return cluster_sizes(members).join(hit, KEYS, "left").select(*KEYS, F.coalesce(F.col("_k") / F.col("size"), F.lit(0.0)).alias("creator_linkage"))


def cluster_signals(
    members: DataFrame, *, funders: DataFrame, hops: DataFrame, sponsors: DataFrame, atomic: DataFrame, facts: DataFrame,
    overlaps: DataFrame, links: DataFrame, repeated: DataFrame, selling: DataFrame,
) -> DataFrame:
    """All twelve signals of every cluster."""
    sizes = cluster_sizes(members)
    out = sizes
    for part in (
        best_shared_share(members, funders, sizes, "common_funder"),
        best_shared_share(members, hops, sizes, "common_intermediary"),
        execution_strength(members, sponsors, atomic),
        measured_similarities(members, facts),
        historical_overlap(members, overlaps),
        linked_share(members, links),
        repeated.select(*KEYS, F.col("best_similarity").alias("repeated_cluster")),
        selling.select(*KEYS, "sell_coordination"),
    ):
        out = out.join(part, KEYS, "left")
    return out.select(*KEYS, "size", *[F.coalesce(s, F.lit(0.0)).alias(s) for s in SIGNALS])


def active_signals(signals: DataFrame, level: float = 0.35) -> DataFrame:
    """Names of the signals at or above ``level``."""
    named = F.array(*[F.when(F.col(s) >= level, F.lit(s)) for s in SIGNALS])
    return signals.select(*KEYS, F.array_compact(named).alias("active"))


def bundle_context(
    members: DataFrame, facts: DataFrame, mayhem: DataFrame, infra_members: DataFrame, selling: DataFrame | None = None, atomic: DataFrame | None = None
) -> DataFrame:
    """What damps or supports a cluster's score.  ``facts`` also carries ``observed``; ``infra_members`` (mint, source, wallet).

    Without ``selling`` or ``atomic`` their columns are left out.
    """
    c = F.col
    rows = members.join(facts.select("mint", "wallet", "age_seconds", "observed"), ["mint", "wallet"], "left")
    shares = rows.groupBy(*KEYS).agg(
        F.avg(F.when(c("age_seconds") < 3600, 1.0).otherwise(0.0)).alias("fresh_share"),
        F.avg(F.when(F.coalesce("observed", F.lit(False)), 0.0).otherwise(1.0)).alias("unobserved_share"),
    )
    infra = common_sources(members, infra_members).select(*KEYS).distinct().withColumn("funder_is_infrastructure", F.lit(True))
    flagged = mayhem.select("mint", F.when(c("trades") > 0, c("flagged_trades") / c("trades")).otherwise(0.0).alias("mayhem_share"))
    out = shares.join(infra, KEYS, "left").join(flagged, "mint", "left")
    added = [F.coalesce("mayhem_share", F.lit(0.0)).alias("mayhem_share")]
    if selling is not None:
        out = out.join(selling.select(*KEYS, "sell_coordination"), KEYS, "left")
        added.append(F.coalesce("sell_coordination", F.lit(0.0)).alias("sell_coordination"))
    if atomic is not None:
        out = out.join(atomic, KEYS, "left")
        added += [F.coalesce("atomic_share", F.lit(0.0)).alias("atomic_share"), F.coalesce("atomic_size", F.lit(0)).cast("long").alias("atomic_size")]
    return out.select(*KEYS, "fresh_share", "unobserved_share", F.coalesce("funder_is_infrastructure", F.lit(False)).alias("funder_is_infrastructure"), *added)
