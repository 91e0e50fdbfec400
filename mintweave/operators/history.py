"""Who appeared together before: overlap between launches and between wallets."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.session import cut


def recurring_groups(members: DataFrame, parts: DataFrame, min_wallets: int = 3, hot_degree: int = 10_000, crowded: int = 200) -> DataFrame:
    """Other launches on which at least ``min_wallets`` of a launch's wallets appeared.

    Two sets that share ``k`` wallets still share one after ``k - 1`` wallets are
    set aside.  So up to ``k - 1`` wallets per launch, the ones on more than
    ``hot_degree`` launches, generate no candidates and are looked up per
    candidate instead: a bot that is on every launch never pairs all launches.

    Launches of up to ``crowded`` members without such wallets take a shorter road:
    the members' launch lists come to the launch once and are counted there, so
    pairs of launches with fewer common wallets never become rows.
    """
    # both are read several times, and making them reads the whole tape
    members, parts = cut(members.select("mint", "wallet"), "members"), cut(parts.select("wallet", "mint"), "parts")
    pairs = parts.select(F.col("mint").alias("other_mint"), "wallet")
    seen = parts.groupBy("wallet").agg(F.count(F.lit(1)).alias("_deg"))
    order = Window.partitionBy("mint").orderBy(F.col("_deg").desc(), "wallet")
    sized = cut(members.join(seen, "wallet").select("mint", "wallet", "_deg"), "sized")
    apart = sized.groupBy("mint").agg(F.count(F.lit(1)).alias("_n"), F.max("_deg").alias("_top"))
    apart = cut(apart.filter((F.col("_n") > crowded) | (F.col("_top") > hot_degree)).select("mint"), "crowded")
    small = _common_launches(sized.join(apart, "mint", "left_anti"), pairs.join(seen.filter(F.col("_deg") <= hot_degree), "wallet", "left_semi"), min_wallets)
    if apart.isEmpty():
        return small
    ranked = sized.join(apart, "mint", "left_semi").withColumn("_r", F.row_number().over(order))
    aside = (F.col("_r") < min_wallets) & (F.col("_deg") > hot_degree)
    frequent = ranked.filter(aside).select("mint", "wallet")
    counted = (
        ranked.filter(~aside)
        .select("mint", "wallet")
        .join(pairs, "wallet")
        .filter(F.col("mint") != F.col("other_mint"))
        .groupBy("mint", "other_mint")
        .agg(F.count(F.lit(1)).alias("_found"))
    )
    limits = frequent.groupBy("mint").agg(F.count(F.lit(1)).alias("_aside"))
    open_pairs = counted.join(limits, "mint").filter(F.col("_found") + F.col("_aside") >= min_wallets)
    extra = (
        open_pairs.join(frequent, "mint")
        .join(pairs, ["other_mint", "wallet"], "left_semi")
        .groupBy("mint", "other_mint")
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    widened = open_pairs.join(extra, ["mint", "other_mint"]).select("mint", "other_mint", (F.col("_found") + F.col("_extra")).alias("wallets"))
    plain = counted.filter(F.col("_found") >= min_wallets).select("mint", "other_mint", F.col("_found").alias("wallets"))
    large = plain.unionByName(widened.filter(F.col("wallets") >= min_wallets)).groupBy("mint", "other_mint").agg(F.max("wallets").alias("wallets"))
    return small.unionByName(large)


def _common_launches(members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Launches that at least ``k`` of a launch's members were on, counted in one sorted list per launch."""
    lists = pairs.groupBy("wallet").agg(F.collect_list("other_mint").alias("_l"))
    heard = members.select("mint", "wallet").join(lists, "wallet").groupBy("mint").agg(F.sort_array(F.flatten(F.collect_list("_l"))).alias("_a"))
    repeated = F.filter("_a", lambda x, i: (i >= k - 1) & (F.get("_a", i - k + 1) == x))
    found = heard.select("mint", "_a", F.explode(F.array_distinct(repeated)).alias("other_mint")).filter(F.col("mint") != F.col("other_mint"))
    times = F.size(F.filter("_a", lambda x: x == F.col("other_mint"))).cast("long")
    return found.select("mint", "other_mint", times.alias("wallets"))


def wallet_overlap_pairs(members: DataFrame, parts: DataFrame, hot_degree: int = 10_000, crowded: int = 200) -> DataFrame:
    """Overlap of two buyers' *other*-launch sets, for buyers of the same launch; only positive overlaps.

    ``members`` holds a bounded number of wallets per launch (the early-buyer
    limit) and every member trades its launch.  On launches of up to ``crowded``
    members the launch lists of ordinary wallets come to the launch once and are
    intersected there; on larger ones ordinary wallets meet through the launches
    they share with each other.  Wallets on more than
    ``hot_degree`` launches take the other road: the smaller of the two launch
    sets is probed against the larger, once per distinct pair.
    """
    members, parts = cut(members.select("mint", "wallet"), "members"), cut(parts.select("wallet", "mint"), "parts")
    degree = parts.groupBy("wallet").agg(F.count(F.lit(1)).alias("deg"))
    sized = members.join(degree, "wallet")
    own = parts.select(F.col("mint").alias("other"), "wallet")
    large = cut(members.groupBy("mint").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > crowded).select("mint"), "crowded")

    # the degree bounds the lists: longer ones are never collected
    lists = own.join(degree.filter(F.col("deg") <= hot_degree), "wallet").groupBy("wallet").agg(F.first("deg").alias("deg"), F.collect_list("other").alias("_l"))
    gathered = (
        members.join(large, "mint", "left_anti")
        .join(lists, "wallet")
        .groupBy("mint")
        .agg(F.array_sort(F.collect_list(F.struct("wallet", "deg", "_l"))).alias("_w"))
        .filter(F.size("_w") > 1)
    )

    def against(x, i):
        def one(y):
            shared = F.size(F.array_remove(F.array_intersect(x["_l"], y["_l"]), F.col("mint")))
            return F.struct(x["wallet"].alias("a"), y["wallet"].alias("b"), shared.cast("long").alias("_shared"), x["deg"].alias("_da"), y["deg"].alias("_db"))

        return F.filter(F.transform(F.slice("_w", i + 2, F.size("_w")), one), lambda p: p["_shared"] > 0)

    compared = gathered.select("mint", F.explode(F.flatten(F.transform("_w", against))).alias("_p")).select("mint", "_p.*")

    met = (
        sized.filter(F.col("deg") <= hot_degree)
        .join(large, "mint", "left_semi")
        .select("mint", "wallet", "deg")
        .join(own, "wallet")
        .filter(F.col("mint") != F.col("other"))
        .groupBy("mint", "other")
        .agg(F.array_sort(F.collect_list(F.struct("wallet", "deg"))).alias("_w"))
        .filter(F.size("_w") > 1)
    )
    later = F.col("_w")
    ordinary = (
        met.select("mint", later.alias("_w"), F.posexplode("_w").alias("_i", "_a"))
        .select("mint", F.col("_a"), F.explode(F.slice("_w", F.col("_i") + 2, F.size("_w"))).alias("_b"))
        .groupBy("mint", F.col("_a.wallet").alias("a"), F.col("_b.wallet").alias("b"))
        .agg(F.count(F.lit(1)).alias("_shared"), F.first("_a.deg").alias("_da"), F.first("_b.deg").alias("_db"))
    )

    hot = sized.filter(F.col("deg") > hot_degree).select("mint", F.col("wallet").alias("h"), F.col("deg").alias("dh"))
    mixed = hot.join(sized, "mint").filter((F.col("h") != F.col("wallet")) & ((F.col("deg") <= hot_degree) | (F.col("h") < F.col("wallet"))))
    hot_pairs = mixed.select(
        "mint",
        F.least("h", "wallet").alias("a"),
        F.greatest("h", "wallet").alias("b"),
        F.when(F.col("h") < F.col("wallet"), F.col("dh")).otherwise(F.col("deg")).alias("_da"),
        F.when(F.col("h") < F.col("wallet"), F.col("deg")).otherwise(F.col("dh")).alias("_db"),
    )
    small_a = F.col("_da") <= F.col("_db")
    probes = hot_pairs.select("a", "b", "_da", "_db").distinct().select(
        "a", "b", F.when(small_a, F.col("a")).otherwise(F.col("b")).alias("wallet"),
        F.when(small_a, F.col("b")).otherwise(F.col("a")).alias("_large"),
    )
    common = (
        probes.join(own, "wallet")
        .select("a", "b", F.col("_large").alias("wallet"), "other")
        .join(own, ["wallet", "other"], "left_semi")
        .groupBy("a", "b")
        .agg((F.count(F.lit(1)) - 1).alias("_shared"))  # the launch itself
    )
    both = ordinary.unionByName(compared).unionByName(hot_pairs.join(common, ["a", "b"]).select(*ordinary.columns))
    smaller = F.least(F.col("_da"), F.col("_db")) - 1
    return both.filter("_shared > 0").select(
        "mint", "a", "b", F.col("_shared").alias("shared_launches"), (F.col("_shared") / smaller).alias("overlap")
    )


def cluster_fingerprints(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Shape and member hash of each cluster, the form kept for later launches.

    ``clusters``: (mint, cluster_id, has_funder, has_intermediary, buy_timing_similarity,
    buy_amount_similarity, wallet_age_similarity).
    """
    who = members.groupBy("mint", "cluster_id").agg(F.array_sort(F.collect_set("wallet")).alias("members"))
    return clusters.join(who, ["mint", "cluster_id"]).select(
        "mint",
        "cluster_id",
        S.size_bucket(F.size("members")).alias("size_bucket"),
        S.topology(F.col("has_funder"), F.col("has_intermediary")).alias("topology"),
        S.ratio_bucket(F.col("buy_timing_similarity")).alias("timing_bucket"),
        S.ratio_bucket(F.col("buy_amount_similarity")).alias("purchase_bucket"),
        S.ratio_bucket(F.col("wallet_age_similarity")).alias("age_bucket"),
        S.members_hash(F.col("members")).alias("members_hash"),
        "members",
    )


SHAPE = ("size_bucket", "topology", "timing_bucket", "purchase_bucket", "age_bucket")


def two_wallets(clusters: DataFrame, members: str) -> DataFrame:
    """Each cluster once per two of its wallets ``_v < _w``, instead of its members."""
    ordered = clusters.withColumn("_ms", F.array_sort(F.array_distinct(members))).drop(members)
    rest = F.slice("_ms", F.col("_i") + 2, F.size("_ms"))
    return ordered.select("*", F.posexplode("_ms").alias("_i", "_v")).withColumn("_w", F.explode(rest)).drop("_ms", "_i")


def match_recurring(
    prints: DataFrame, known: DataFrame, threshold: float = P.RECURRING_THRESHOLD, listed: int = 10, hot_degree: int = 10_000, crowded: int = 32
) -> DataFrame:
    """Earlier clusters of other launches that look like each cluster.

    Similarity is ``0.6 * member overlap + 0.4 * equal shape buckets``.  Shape
    alone reaches 0.4, so above that a shared member is necessary and an
    equi-join on members is exact.  Below it pairs with enough equal buckets are added.

    Among clusters of three members or more a single shared wallet is worth 0.2
    at most.  Where that needs all five buckets equal, clusters of three to
    ``crowded`` members meet through a shared wallet and the whole shape, or
    through two shared wallets, so pairs with one wallet and another shape never
    become rows.  Pairs with a smaller or larger cluster meet through each shared
    wallet; with larger ones a wallet in more than ``hot_degree`` stored clusters would pair
    them all, so one hot wallet per cluster joins on the shape too and is only
    looked up for the pairs found otherwise.
    """
    left = prints.select("mint", "cluster_id", F.size("members").alias("_n"), *SHAPE, "members")
    right = known.select(
        F.col("mint").alias("other_mint"), F.col("cluster_id").alias("other_id"), F.size("members").alias("_m"),
        *[F.col(c).alias(f"_k_{c}") for c in SHAPE], F.col("members").alias("_k_members"),
    )
    same = [F.col(c) == F.col(f"_k_{c}") for c in SHAPE]
    equal = sum((F.when(s, 1).otherwise(0) for s in same), F.lit(0)) / 5.0
    a = left.withColumn("wallet", F.explode("members")).drop("members")
    b = right.withColumn("wallet", F.explode("_k_members")).drop("_k_members")
    ids = ["mint", "cluster_id", "other_mint", "other_id"]
    other = F.col("mint") != F.col("other_mint")
    shape_needed = threshold - 0.2 > 0.4 * 0.8 + 1e-9

    def met(a, b):
        """Pairs with a common wallet: ``_both`` is how many."""
        return (
            a.join(b, "wallet")
            .filter(other)
            .groupBy(*ids)
            .agg(F.count(F.lit(1)).alias("_both"), F.first("_n").alias("_n"), F.first("_m").alias("_m"), F.first(equal).alias("_equal"))
        )

    def met_with_hot(a, b):
        degree = every_b.groupBy("wallet").agg(F.count(F.lit(1)).alias("_deg")).filter(F.col("_deg") > hot_degree)
        first = Window.partitionBy("mint", "cluster_id").orderBy(F.col("_deg").desc_nulls_last(), "wallet")
        marked = a.join(degree, "wallet", "left").withColumn("_r", F.row_number().over(first))
        aside = F.col("_deg").isNotNull() & (F.col("_r") == 1)
        hot = marked.filter(aside).drop("_deg", "_r")
        found = met(marked.filter(~aside).drop("_deg", "_r"), b)
        keep = hot.select("mint", "cluster_id", "wallet")
        looked = found.select(*ids).join(keep, ["mint", "cluster_id"]).join(b.select("other_mint", "other_id", "wallet"), ["other_mint", "other_id", "wallet"], "left_semi")
        found = found.join(looked.select(*ids, F.lit(1).alias("_more")), ids, "left").withColumn("_both", F.col("_both") + F.coalesce("_more", F.lit(0))).drop("_more")
        alone = hot.join(b, [hot["wallet"] == b["wallet"], *same]).filter(other).select(*ids, F.lit(1).alias("_both"), "_n", "_m", F.lit(1.0).alias("_equal"))
        return found.unionByName(alone)

    if shape_needed:
        every_b = b
        usual = {x: (F.col(x) >= 3) & (F.col(x) <= crowded) for x in ("_n", "_m")}
        shape = ["wallet", *SHAPE]
        alike = (
            a.filter(usual["_n"]).select(*shape, "mint", "cluster_id", "_n")
            .join(b.filter(usual["_m"]).select("wallet", *[F.col(f"_k_{c}").alias(c) for c in SHAPE], "other_mint", "other_id", "_m"), shape)
            .filter(other)
            .groupBy(*ids)
            .agg(F.count(F.lit(1)).alias("_both"), F.first("_n").alias("_n"), F.first("_m").alias("_m"), F.lit(1.0).alias("_equal"))
        )
        twos = two_wallets(left.filter(usual["_n"]), "members").join(two_wallets(right.filter(usual["_m"]), "_k_members"), ["_v", "_w"])
        met_twice = twos.filter(other).filter(equal < 1.0).groupBy(*ids).agg(
            F.count(F.lit(1)).alias("_p"), F.first("_n").alias("_n"), F.first("_m").alias("_m"), F.first(equal).alias("_equal")
        )
        # k common wallets are k * (k - 1) / 2 common pairs
        common = F.round((1 + F.sqrt(1 + 8 * F.col("_p"))) / 2).cast("long")
        found = alike.unionByName(met_twice.select(*ids, common.alias("_both"), "_n", "_m", "_equal"))
        tiny, big = ({x: condition(F.col(x)) for x in ("_n", "_m")} for condition in (lambda n: n < 3, lambda n: n > crowded))
        some = {(side, x): not df.filter(kind[x]).isEmpty() for df, x in ((left, "_n"), (right, "_m")) for side, kind in (("tiny", tiny), ("big", big))}
        # one wallet may be enough with a cluster of one or two, so none is set aside there
        if some["tiny", "_n"]:
            found = found.unionByName(met(a.filter(tiny["_n"]), b))
        if some["tiny", "_m"]:
            found = found.unionByName(met(a.filter(~tiny["_n"]), b.filter(tiny["_m"])))
        if some["big", "_n"]:
            found = found.unionByName(met_with_hot(a.filter(big["_n"]), b.filter(~tiny["_m"])))
        if some["big", "_m"]:
            found = found.unionByName(met_with_hot(a.filter(usual["_n"]), b.filter(big["_m"])))
    else:
        found = met(a, b)
    scored = found.select(*ids, (0.6 * F.col("_both") / F.least("_n", "_m") + 0.4 * F.col("_equal")).alias("similarity"))
    if threshold <= 0.4:
        need = math.ceil(threshold / 0.4 * 5 - 1e-9)
        if need < 1:
            raise ValueError("a threshold that no bucket needs to meet pairs all clusters")
        # pairs without a shared member: one equi-join per choice of buckets that must be equal
        apart = other & ~F.arrays_overlap("members", "_k_members")
        for chosen in combinations(range(len(SHAPE)), need):
            fewer = [~same[k] for k in range(max(chosen)) if k not in chosen]
            # counted at its first equal buckets only
            shaped = left.join(right, [same[k] for k in chosen]).filter(apart)
            for condition in fewer:
                shaped = shaped.filter(condition)
            scored = scored.unionByName(shaped.select(*ids, (0.4 * equal).alias("similarity")))
    hits = scored.filter(F.col("similarity") >= threshold - 1e-12)
    per_mint = hits.groupBy("mint", "cluster_id", "other_mint").agg(F.max("similarity").alias("similarity"))
    total = per_mint.groupBy("mint", "cluster_id").agg(F.count(F.lit(1)).alias("matches"), F.max("similarity").alias("best_similarity"))
    top = Window.partitionBy("mint", "cluster_id").orderBy(F.col("similarity").desc(), "other_mint")
    names = (
        per_mint.withColumn("_r", F.row_number().over(top))
        .filter(F.col("_r") <= listed)
        .groupBy("mint", "cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "other_mint"))).alias("_l"))
        .select("mint", "cluster_id", F.transform("_l", lambda x: x["other_mint"]).alias("recurring_launches"))
    )
    return total.join(names, ["mint", "cluster_id"])


def compare_launches(pairs: DataFrame, buyers: DataFrame, launches: DataFrame) -> DataFrame:
    """Shared buyers and creator of given launch pairs (``mint_a, mint_b``)."""
    who = buyers.select("mint", "wallet").distinct()
    first = pairs.join(who.withColumnRenamed("mint", "mint_a"), "mint_a")
    shared = (
        first.join(who.withColumnRenamed("mint", "mint_b"), ["mint_b", "wallet"], "left_semi")
        .groupBy("mint_a", "mint_b")
        .agg(F.count(F.lit(1)).alias("shared_wallets"))
    )
    by = launches.select("mint", "creator")
    return (
        pairs.join(shared, ["mint_a", "mint_b"], "left")
        .join(by.select(F.col("mint").alias("mint_a"), F.col("creator").alias("creator_a")), "mint_a", "left")
        .join(by.select(F.col("mint").alias("mint_b"), F.col("creator").alias("creator_b")), "mint_b", "left")
        .select(
            "mint_a", "mint_b", F.coalesce("shared_wallets", F.lit(0)).cast("long").alias("shared_wallets"),
            F.coalesce(F.col("creator_a") == F.col("creator_b"), F.lit(False)).alias("same_creator"),
        )
    )
