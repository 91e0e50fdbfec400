"""Creators: their other launches, their money, their links to buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators.entities import scope_keys
from mintweave.operators.funding import asof_funding
from mintweave.operators.skew import DAY, first_n



def newest_launch_first():
    return [F.col("created_at").desc(), F.col("mint").desc()]



def creator_history(launches: DataFrame, trades: DataFrame) -> DataFrame:
    """Per launch: how many others its creator made, and the creator's sells after graduation."""
    total = launches.groupBy("creator").agg(F.count(F.lit(1)).alias("launches_total"))
    sold = (
        trades.filter("not is_buy")
        .join(launches.filter("graduated_at is not null").select("mint", F.col("creator").alias("wallet"), "graduated_at"), ["mint", "wallet"])
        .filter(F.col("block_time") >= F.col("graduated_at"))
        .groupBy("wallet")
        .agg(F.count(F.lit(1)).alias("post_graduation_sells"))
        .withColumnRenamed("wallet", "creator")
    )
    return launches.select("mint", "creator").join(total.join(sold, "creator", "left"), "creator").select(
        "mint", "creator", "launches_total", (F.col("launches_total") - 1).alias("previous_launches"),
        F.coalesce("post_graduation_sells", F.lit(0)).cast("long").alias("post_graduation_sells"),
    )


def creator_graduations(launches: DataFrame, checked: int = 12) -> DataFrame:
    """Graduation record over the newest ``checked`` *other* launches of each creator.

    The newest ``checked + 1`` launches per creator answer it for every launch:
    one inside that list leaves itself out, any other leaves the oldest out.
    """
    top = first_n(launches.select("mint", "creator", "created_at", "curve_complete"), ["creator"], newest_launch_first(), checked + 1, out="_r")
    done = F.when(F.coalesce("curve_complete", F.lit(False)), 1).otherwise(0)
    per_creator = top.groupBy("creator").agg(
        F.count(F.lit(1)).alias("_listed"),
        F.sum(done).alias("_all"),
        F.sum(F.when(F.col("_r") <= checked, done).otherwise(0)).alias("_head"),
    )
    listed = top.select("mint", F.lit(True).alias("_in"), done.alias("_own"))
    out = launches.select("mint", "creator").join(per_creator, "creator").join(listed, "mint", "left")
    graduated = F.when(F.col("_in"), F.col("_all") - F.col("_own")).otherwise(F.col("_head"))
    n = F.col("_listed") - 1
    return out.select(
        "mint", "creator", n.alias("checked"), graduated.alias("graduated"), (n - graduated).alias("abandoned"),
        F.when(n > 0, graduated / n).alias("graduation_rate"),
    )


def creator_funding(launches: DataFrame, upstream: DataFrame) -> DataFrame:
    src = upstream.select(F.col("address").alias("creator"), F.col("parent").alias("funding_source"), F.col("amount").alias("funding_amount"))
    return launches.select("mint", "creator").join(src, "creator", "left").select("mint", "creator", "funding_source", "funding_amount")


def creator_funding_before(launches: DataFrame, transfers: DataFrame, width: int = 30 * DAY) -> DataFrame:
    """The newest inflow of each creator strictly before its launch: money that came later cannot have paid for it."""
    made = launches.select(
        "mint", F.col("creator").alias("wallet"), F.col("created_at").alias("block_time"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("string").alias("signature")
    ).filter("wallet is not null and block_time is not null")
    found = asof_funding(made, transfers, lookback=None, width=width)
    money = found.select("mint", F.col("direct_funder").alias("funding_source"), "funding_amount", "funding_time")
    return launches.select("mint", "creator").join(money, "mint", "left")


def creator_links(
    funded_by: DataFrame, paths: DataFrame, creators: DataFrame, assessment: DataFrame | None = None,
    scope: str = "global", max_hops: int = P.MAX_HOPS,
) -> DataFrame:
    """Buyers whose funding path meets the creator or the creator's private funder.

    ``funded_by``: funding rows; ``creators``: (mint, creator, funding_source).
    """
    own = creators.select("mint", F.col("creator").alias("address"), "creator")
    via = creators.filter("funding_source is not null").select("mint", F.col("funding_source").alias("address"), "creator")
    if assessment is not None:
        keys = scope_keys(scope)
        via = via.join(assessment.filter("shared").select(*keys).distinct(), keys, "left_anti")
    sources = own.unionByName(via).distinct()
    above = paths.select(
        "mint", "wallet", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("address"), F.size("path").alias("_len"), "path"
    )
    direct = funded_by.filter("direct_funder is not null").join(paths.select("mint", "wallet"), ["mint", "wallet"], "left_anti").select(
        "mint", "wallet", F.col("direct_funder").alias("address"), F.lit(2).alias("_len"), F.array("direct_funder", "wallet").alias("path")
    )
    hops = F.col("_len") - 1
    return (
        above.unionByName(direct)
        .join(sources, ["mint", "address"])
        .filter((F.col("wallet") != F.col("creator")) & (hops <= max_hops))
        .groupBy("mint", "creator", "wallet")
        .agg(F.min(hops).alias("hops"), F.min("path").alias("path"))
    )


def creator_risk(creators: DataFrame) -> DataFrame:
    """0-100 per launch from ``linked``, ``previous_launches``, ``launches_total``, ``graduation_rate``, ``post_graduation_sells``."""
    linked, previous = F.col("linked"), F.col("previous_launches")
    rate, many = F.col("graduation_rate"), F.col("launches_total") > 3
    rules = [
        (linked > 0, F.least(F.lit(40.0), 12.0 * linked), "buyers linked to the creator by funding"),
        (previous >= 20, F.lit(20.0), "twenty or more launches before"),
        ((previous >= 5) & (previous < 20), F.lit(12.0), "five or more launches before"),
        ((previous > 0) & (previous < 5), F.lit(5.0), "launched before"),
        ((rate <= 0.1) & many, F.lit(15.0), "few launches graduated"),
        ((rate >= 0.5) & many, F.lit(0.0), "an established track record"),
        (F.col("post_graduation_sells") > 0, F.lit(10.0), "sold after graduation"),
    ]
    points = sum((F.when(rule, p).otherwise(0.0) for rule, p, _ in rules), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, _, text in rules]))
    return creators.withColumn("creator_risk", S.half_even(F.least(F.lit(100.0), points))).withColumn(
        "creator_reasons", F.when(F.size(reasons) == 0, F.array(F.lit("no adverse creator signal"))).otherwise(reasons)
    )
