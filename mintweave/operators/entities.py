"""What an address is, and how much a shared funder counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S


def classify_entities(
    addresses: DataFrame,
    entities: DataFrame,
    provider_labels: DataFrame | None = None,
    default: str = "UNKNOWN",
) -> DataFrame:
    """Label each ``address``: the registry first, then a provider's free-text label, then the default."""
    known = entities.select(
        "address",
        F.col("label").alias("_label"),
        F.col("entity_type").alias("_type"),
        F.col("source").alias("_source"),
        F.col("confidence").alias("_conf"),
    )
    out = addresses.join(known, "address", "left")
    if provider_labels is not None:
        named = provider_labels.filter(F.length("label") > 0).select("address", F.col("label").alias("_text"))
        out = out.join(named, "address", "left")
    else:
        out = out.withColumn("_text", F.lit(None).cast("string"))
    guess = S.label_to_entity(F.col("_text"))
    registered, named_by = F.col("_type").isNotNull(), F.col("_text").isNotNull()
    return out.select(
        *addresses.columns,
        F.when(registered, F.col("_label")).otherwise(F.col("_text")).alias("label"),
        F.coalesce("_type", guess, F.lit(default)).alias("entity_type"),
        F.when(registered, F.col("_source")).when(named_by, "provider_label").otherwise("none").alias("label_source"),
        F.when(registered, F.col("_conf")).when(guess.isNotNull(), 0.7).when(named_by, 0.4).otherwise(0.0).alias("confidence"),
    )


def scope_keys(scope: str) -> list[str]:
    """``mint`` judges a funder within one launch, ``global`` over the whole market."""
    if scope not in ("mint", "global"):
        raise ValueError(f"unknown scope {scope}")
    return ["mint", "address"] if scope == "mint" else ["address"]


def fanout(pairs: DataFrame, scope: str = "global") -> DataFrame:
    """Distinct recipients per source.  ``pairs``: ``[mint,] address, recipient``."""
    keys = scope_keys(scope)
    return pairs.groupBy(*keys, "recipient").agg(F.lit(1).alias("_x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("fanout"))


def activity(wallet_tx: DataFrame) -> DataFrame:
    """Number of transactions per address."""
    return wallet_tx.groupBy("address").agg(F.count(F.lit(1)).alias("activity"))


def assess_funders(
    sources: DataFrame,
    entities: DataFrame,
    fanouts: DataFrame,
    activities: DataFrame | None = None,
    provider_labels: DataFrame | None = None,
    scope: str = "global",
    fanout_threshold: int = P.INFRA_FANOUT,
    activity_threshold: int = P.INFRA_ACTIVITY,
    damping: float = P.INFRA_DAMPING,
) -> DataFrame:
    """Weight of each funding source: exchanges and shared services count little, private wallets fully."""
    keys = scope_keys(scope)
    out = classify_entities(sources.select(*keys).distinct(), entities, provider_labels, default="FUNDER")
    out = out.join(fanouts, keys, "left").withColumn("fanout", F.coalesce("fanout", F.lit(0)).cast("long"))
    if activities is not None:
        out = out.join(activities, "address", "left")
    else:
        out = out.withColumn("activity", F.lit(None).cast("long"))
    exchange = F.col("entity_type") == "CEX"
    protocol = S.is_infrastructure(F.col("entity_type"))
    wide = F.col("fanout") >= fanout_threshold
    busy = F.coalesce(F.col("activity") >= activity_threshold, F.lit(False))

    def pick(cex, infra, by_fanout, by_activity, private) -> Column:
        return F.when(exchange, cex).when(protocol, infra).when(wide, by_fanout).when(busy, by_activity).otherwise(private)

    kind = F.col("entity_type")
    weight = pick(damping, 0.0, damping, damping, 1.0)
    assessed = pick(kind, kind, "INFRASTRUCTURE", "INFRASTRUCTURE", F.lit("FUNDER"))
    source = F.col("label_source")
    return out.select(
        *keys,
        "label",
        assessed.alias("entity_type"),
        pick(source, source, "inferred:fanout", "inferred:activity", source).alias("label_source"),
        "confidence",
        "fanout",
        "activity",
        weight.alias("weight"),
        ((weight < 1.0) | S.is_infrastructure(assessed)).alias("shared"),
        pick(
            F.concat(F.coalesce("label", F.lit("an exchange")), F.lit(": exchange withdrawals are expected between strangers")),
            F.concat(F.coalesce("label", F.lit("infrastructure")), F.lit(": protocol account, not a user wallet")),
            F.concat(F.lit("funded "), F.col("fanout").cast("string"), F.lit(" distinct wallets, like a shared service")),
            F.concat(F.lit("at least "), F.col("activity").cast("string"), F.lit(" transactions, like a shared service")),
            F.lit("no exchange, program or high-fan-out mark; taken as a private funder"),
        ).alias("reason"),
    )


def registry_summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(
        F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("verify"), 1)).alias("needs_verification")
    )


def entity_addresses_by_type(labelled: DataFrame) -> DataFrame:
    """Addresses under each entity type, one row each: a type may hold any number of them."""
    return labelled.select("entity_type", "address").distinct()


def entity_overrides(entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Operator-edited labels replace the bundled ones."""
    kept = entities.join(overrides.select("address"), "address", "left_anti")
    return overrides.unionByName(kept)
