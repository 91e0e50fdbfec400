"""Links that follow from how buy transactions were built: who paid the fee, who shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.operators.tape import early_buys


def sponsored_buys(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """Early buys whose fee another address paid."""
    return early_buys(trades, n).filter(F.col("fee_payer").isNotNull() & (F.col("fee_payer") != F.col("wallet")))


def sponsor_members(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """(mint, source, wallet) for fee payers behind at least two buyers."""
    pairs = sponsored_buys(trades, n).select("mint", F.col("fee_payer").alias("source"), "wallet").distinct()
    return _groups_of_two(pairs)


def execution_sponsors(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """One row per fee payer with two or more buyers."""
    per_wallet = sponsored_buys(trades, n).groupBy("mint", "fee_payer", "wallet").agg(
        F.count(F.lit(1)).alias("_buys"), F.min("signature").alias("_sig")
    )
    return (
        per_wallet.groupBy("mint", "fee_payer")
        .agg(
            F.count(F.lit(1)).alias("wallets"),
            F.sum("_buys").alias("sponsored_buys"),
            F.min("_sig").alias("first_signature"),
        )
        .filter("wallets >= 2")
    )


def sponsor_signatures(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """The transactions that support each sponsor group, one row each."""
    groups = execution_sponsors(trades, n).select("mint", "fee_payer")
    return sponsored_buys(trades, n).select("mint", "fee_payer", "signature", "wallet").distinct().join(
        groups, ["mint", "fee_payer"], "left_semi"
    )


def atomic_members(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """(mint, source = signature, wallet) for transactions with at least two buyers."""
    pairs = early_buys(trades, n).select("mint", F.col("signature").alias("source"), "wallet").distinct()
    return _groups_of_two(pairs)


def execution_atomic_groups(trades: DataFrame, n: int | None = 100) -> DataFrame:
    pairs = early_buys(trades, n).select("mint", "signature", "wallet").distinct()
    return (
        pairs.groupBy("mint", "signature")
        .agg(F.count(F.lit(1)).alias("wallets"), F.min("wallet").alias("first_wallet"), F.max("wallet").alias("last_wallet"))
        .filter("wallets >= 2")
    )


def _groups_of_two(pairs: DataFrame) -> DataFrame:
    keep = pairs.groupBy("mint", "source").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    return pairs.join(keep, ["mint", "source"], "left_semi")


def _shared_counts(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of each cluster reached by each group, where at least two are."""
    return (
        members.select("mint", "cluster_id", "wallet")
        .join(groups, ["mint", "wallet"])
        .groupBy("mint", "cluster_id", "source")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter("shared >= 2")
    )


def best_shared_share(members: DataFrame, groups: DataFrame, sizes: DataFrame, out: str) -> DataFrame:
    """Largest share of a cluster that any single source reaches."""
    best = _shared_counts(members, groups).groupBy("mint", "cluster_id").agg(F.max("shared").alias("_best"))
    return sizes.join(best, ["mint", "cluster_id"], "left").select(
        "mint", "cluster_id", F.coalesce(F.col("_best") / F.col("size"), F.lit(0.0)).alias(out)
    )


def cluster_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("mint", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def execution_strength(members: DataFrame, sponsors: DataFrame, atomic: DataFrame) -> DataFrame:
    """Share of a cluster tied by one signer; a shared transaction counts a quarter more."""
    sizes = cluster_sizes(members)
    paid = best_shared_share(members, sponsors, sizes, "_paid")
    joint = best_shared_share(members, atomic, sizes, "_joint")
    return paid.join(joint, ["mint", "cluster_id"]).select(
        "mint",
        "cluster_id",
        F.least(F.lit(1.0), F.greatest(F.col("_paid"), F.col("_joint") * 1.25)).alias("shared_signer"),
    )


def atomic_stats(members: DataFrame, atomic: DataFrame) -> DataFrame:
    """Largest shared transaction and the share of members inside any such transaction."""
    sizes = cluster_sizes(members)
    inside = members.select("mint", "cluster_id", "wallet").join(atomic, ["mint", "wallet"])
    counted = inside.groupBy("mint", "cluster_id", "source").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    largest = counted.groupBy("mint", "cluster_id").agg(F.max("_n").alias("_largest"))
    covered = (
        inside.join(counted.drop("_n"), ["mint", "cluster_id", "source"], "left_semi")
        .select("mint", "cluster_id", "wallet").distinct()
        .groupBy("mint", "cluster_id").agg(F.count(F.lit(1)).alias("_covered"))
    )
    keys = ["mint", "cluster_id"]
    return sizes.join(largest, keys, "left").join(covered, keys, "left").select(
        *keys,
        F.coalesce("_largest", F.lit(0)).alias("atomic_size"),
        F.coalesce(F.col("_covered") / F.col("size"), F.lit(0.0)).alias("atomic_share"),
    )


def linked_wallets(trades: DataFrame, n: int | None = 100) -> DataFrame:
    """Every wallet tied to another by a fee payer or a shared transaction."""
    return sponsor_members(trades, n).unionByName(atomic_members(trades, n)).select("mint", "wallet").distinct()
