"""Exits: how much was sold, when, and whether members of a group left together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators.skew import first_n
from mintweave.sources.schemas import TAPE_ORDER


def wallet_exits(trades: DataFrame) -> DataFrame:
    """Sold fraction, exit kind and hold time per (mint, wallet); plain mergeable sums and minima."""
    buy, sell = F.col("is_buy"), ~F.col("is_buy")
    order = F.struct("block_time", "slot", "signature")
    sums = trades.groupBy("mint", "wallet").agg(
        F.coalesce(F.sum(F.when(buy, F.col("token_amount"))), F.lit(0.0)).alias("bought"),
        F.coalesce(F.sum(F.when(sell, F.col("token_amount"))), F.lit(0.0)).alias("sold"),
        F.count(F.when(sell, 1)).alias("sells"),
        F.min(F.when(buy, order)).alias("_buy"),
        F.min(F.when(sell, order)).alias("_sell"),
    )
    fraction = F.when(F.col("bought") > 0, F.col("sold") / F.col("bought")).otherwise(0.0)
    hold = (S.known(F.col("_sell.block_time")) - S.known(F.col("_buy.block_time"))).cast("double")
    return sums.select(
        "mint",
        "wallet",
        "bought",
        "sold",
        "sells",
        F.least(F.lit(1.0), fraction).alias("sold_fraction"),
        F.when(fraction >= 0.95, "full").when(fraction > 0.01, "partial").otherwise("holding").alias("exit_kind"),
        F.col("_sell.block_time").alias("first_sell_time"),
        hold.alias("hold_seconds"),
    )


def exit_signatures(trades: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` sell signatures per (mint, wallet), in tape order."""
    return (
        first_n(trades.filter("not is_buy"), ["mint", "wallet"], TAPE_ORDER, n)
        .groupBy("mint", "wallet")
        .agg(F.array_sort(F.collect_list(F.struct("position", "signature"))).alias("_s"))
        .select("mint", "wallet", F.transform("_s", lambda x: x["signature"]).alias("signatures"))
    )


def sync_exit_groups(members: DataFrame, exits: DataFrame, window: float = P.EXIT_WINDOW) -> DataFrame:
    """Sellers of a cluster grouped by first sell: a group spans ``window`` from its FIRST member.

    Anchored at the first member, so not a gap session.  One ordered fold over
    the cluster, whose size the early-buyer limit bounds.
    """
    sellers = members.select("mint", "cluster_id", "wallet").join(
        exits.filter("exit_kind <> 'holding' and first_sell_time is not null").select("mint", "wallet", "first_sell_time"), ["mint", "wallet"]
    )
    listed = sellers.groupBy("mint", "cluster_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("first_sell_time").alias("t"), F.col("wallet").cast("string").alias("w")))).alias("_e")
    )
    start = F.expr("named_struct('anchor', cast(null as bigint), 'g', 0, 'out', array_remove(array(named_struct('t', 0L, 'w', '', 'g', 0)), named_struct('t', 0L, 'w', '', 'g', 0)))")

    def step(acc, e):
        fresh = acc["anchor"].isNull() | ((e["t"] - acc["anchor"]) > window)
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"])
        item = F.struct(e["t"].alias("t"), e["w"].alias("w"), g.alias("g"))
        return F.struct(F.when(fresh, e["t"]).otherwise(acc["anchor"]).alias("anchor"), g.alias("g"), F.array_append(acc["out"], item).alias("out"))

    folded = listed.select("mint", "cluster_id", F.explode(F.aggregate("_e", start, step, lambda acc: acc["out"])).alias("_x"))
    return (
        folded.groupBy("mint", "cluster_id", F.col("_x.g").alias("exit_group"))
        .agg(
            F.count(F.lit(1)).alias("wallets"),
            F.min("_x.t").alias("first_time"),
            F.max("_x.t").alias("last_time"),
            F.array_sort(F.collect_list("_x.w")).alias("members"),
        )
        .filter("wallets > 1")
    )


def sell_coordination(members: DataFrame, exits: DataFrame, window: float = P.EXIT_WINDOW) -> DataFrame:
    """Did the members of each cluster sell at the same moment and in the same proportion?"""
    rows = members.select("mint", "cluster_id", "wallet").join(exits, ["mint", "wallet"])
    seller = F.col("exit_kind") != "holding"
    time = F.when(seller, F.col("first_sell_time"))
    fraction = F.when(seller, F.col("sold_fraction"))
    out = rows.groupBy("mint", "cluster_id").agg(
        F.count(F.when(seller, 1)).alias("sellers"),
        F.count(F.when(~seller, 1)).alias("holders"),
        F.median("hold_seconds").alias("median_hold"),
        S.timing_similarity(time, window).alias("timing"),
        S.amount_similarity(fraction).alias("size_similarity"),
    )
    both = F.col("timing") * (0.6 + 0.4 * F.col("size_similarity"))
    return out.withColumn("sell_coordination", F.when(F.col("sellers") >= 2, both).otherwise(0.0))


def post_graduation(trades: DataFrame, launches: DataFrame) -> DataFrame:
    """What each buyer of a graduated launch did after it: sold_after, sold_before or held."""
    times = trades.groupBy("mint", "wallet").agg(
        F.max(F.when(~F.col("is_buy"), F.coalesce("block_time", F.lit(0)))).alias("_last"),
        F.count(F.when(F.col("is_buy"), 1)).alias("_buys"),
    )
    grads = launches.filter("graduated_at is not null").select("mint", "graduated_at")
    return times.filter("_buys > 0").join(grads, "mint").select(
        "mint",
        "wallet",
        F.when(F.col("_last") >= F.col("graduated_at"), "sold_after").when(F.col("_last").isNotNull(), "sold_before").otherwise("held").alias("behaviour"),
    )
