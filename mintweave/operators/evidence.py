"""Findings about a cluster, each with its wallets, supporting signatures, strength and caveat.

Every generator returns ``mint, cluster_id, code, item, wallets, signatures,
strength``; clusters hold early buyers only, so the arrays are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["mint", "cluster_id"]

# code -> (title, caveat)
TEXTS = {
    "ATOMIC_EXECUTION": ("buyers inside one transaction", "shows one operator at work, not one owner"),
    "SHARED_FEE_PAYER": ("one address paid the fees of several buyers", "fee sponsorship is also sold as a service"),
    "COMMON_FUNDER": ("common private funding source", "a payment relation, not common ownership"),
    "INFRASTRUCTURE_FUNDER": ("shared funding source is infrastructure", "not treated as evidence of coordination"),
    "COMMON_INTERMEDIARY": ("common intermediary in the funding path", "paths follow balance movements and may include relays"),
    "FUNDING_WINDOW": ("funded right before buying", "also normal for a trader topping up a hot wallet"),
    "ENTRY_SYNCHRONISATION": ("entries clustered in time", "independent bots aim at the same moment"),
    "BUY_SIZE_SIMILARITY": ("near-identical purchase sizes", "round sizes are common; insufficient alone"),
    "FRESH_WALLETS": ("wallets created shortly before", "a new wallet is a signal, never a verdict"),
    "REPEATED_CO_PARTICIPATION": ("same wallets on an earlier launch", "active traders overlap by chance"),
    "CREATOR_LINK": ("creator connected to buyers", "a shared funder does not prove control"),
    "EXIT_COORDINATION": ("coordinated exit", "a sharp price move makes many exit at once"),
    "MAYHEM_MODE": ("mayhem mode active", "measured apart and removed from the coordination signals"),
}


def _finding(rows: DataFrame, code: str, item: Column, wallets: Column, signatures: Column, strength: Column) -> DataFrame:
    return rows.select(
        *KEYS, F.lit(code).alias("code"), item.cast("string").alias("item"), wallets.cast("array<string>").alias("wallets"),
        signatures.cast("array<string>").alias("signatures"), strength.cast("double").alias("strength"),
    )


def _wallets() -> Column:
    return F.array_sort(F.collect_set(F.col("wallet").cast("string"))).alias("wallets")


def _signatures(column: str = "funding_signature", n: int | None = None) -> Column:
    found = F.array_sort(F.collect_set(column))
    return (found if n is None else F.slice(found, 1, n)).alias("signatures")


NONE = "cast(array() as array<string>)"


def _by_source(members: DataFrame, groups: DataFrame, at_least: int, facts: DataFrame | None = None) -> DataFrame:
    """Members of each cluster per source, where there are enough."""
    rows = members.join(groups.select("mint", "source", "wallet"), ["mint", "wallet"])
    if facts is None:
        rows = rows.withColumn("funding_signature", F.lit(None).cast("string"))
    else:
        rows = rows.join(facts.select("mint", "wallet", "funding_signature"), ["mint", "wallet"], "left")
    grouped = rows.groupBy(*KEYS, "source").agg(_wallets(), _signatures(), F.count(F.lit(1)).alias("n"))
    return grouped.filter(F.col("n") >= at_least)


def evidence_atomic(members: DataFrame, atomic: DataFrame) -> DataFrame:
    rows = _by_source(members, atomic, 2)
    return _finding(rows, "ATOMIC_EXECUTION", F.col("source"), F.col("wallets"), F.array("source"), F.lit(1.0))


def evidence_fee_payer(members: DataFrame, sponsors: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """``signatures``: (mint, fee_payer, signature) rows that back the sponsor groups; at most ten are listed."""
    rows = _by_source(members, sponsors, 2)
    if signatures is None:
        listed = F.expr(NONE)
    else:
        w = Window.partitionBy("mint", "fee_payer").orderBy("signature")
        first = signatures.select("mint", "fee_payer", "signature").distinct().withColumn("_r", F.row_number().over(w)).filter("_r <= 10")
        first = first.groupBy("mint", F.col("fee_payer").alias("source")).agg(F.array_sort(F.collect_list("signature")).alias("_s"))
        rows = rows.join(first, ["mint", "source"], "left")
        listed = F.col("_s")
    return _finding(rows, "SHARED_FEE_PAYER", F.col("source"), F.col("wallets"), listed, F.lit(0.85))


def evidence_common_funder(members: DataFrame, private: DataFrame, facts: DataFrame) -> DataFrame:
    rows = _by_source(members, private, 2, facts)
    strength = F.least(F.lit(1.0), 0.5 + 0.1 * F.col("n"))
    return _finding(rows, "COMMON_FUNDER", F.col("source"), F.col("wallets"), F.col("signatures"), strength)


def evidence_infra_funder(members: DataFrame, infra: DataFrame, facts: DataFrame) -> DataFrame:
    rows = _by_source(members, infra, 2, facts)
    return _finding(rows, "INFRASTRUCTURE_FUNDER", F.col("source"), F.col("wallets"), F.col("signatures"), F.lit(0.15))


def evidence_intermediary(members: DataFrame, hops: DataFrame) -> DataFrame:
    rows = _by_source(members, hops, 3)
    strength = F.least(F.lit(0.9), 0.4 + 0.08 * F.col("n"))
    return _finding(rows, "COMMON_INTERMEDIARY", F.col("source"), F.col("wallets"), F.expr(NONE), strength)


def _over(members: DataFrame, facts: DataFrame, usable: Column, *measures: Column) -> DataFrame:
    rows = members.join(facts, ["mint", "wallet"]).filter(usable)
    return rows.groupBy(*KEYS).agg(_wallets(), F.count(F.lit(1)).alias("n"), *measures).filter("n >= 3")


def evidence_funding_window(members: DataFrame, facts: DataFrame, seconds: float = 60) -> DataFrame:
    delay = F.col("funding_to_buy_seconds")
    rows = _over(members, facts, delay.isNotNull(), F.max(delay).alias("_max"), _signatures(n=8)).filter(F.col("_max") <= seconds)
    return _finding(rows, "FUNDING_WINDOW", F.lit(None), F.col("wallets"), F.col("signatures"), F.lit(0.75))


def evidence_entry_sync(members: DataFrame, facts: DataFrame, seconds: float = 120, tight: float = 15) -> DataFrame:
    t = F.col("block_time")
    rows = _over(members, facts, F.coalesce(t, F.lit(0)) != 0, (F.max(t) - F.min(t)).alias("_span"), _signatures("buy_signature", 10))
    rows = rows.filter(F.col("_span") <= seconds)
    strength = F.when(F.col("_span") <= tight, 0.7).otherwise(0.5)
    return _finding(rows, "ENTRY_SYNCHRONISATION", F.lit(None), F.col("wallets"), F.col("signatures"), strength)


def evidence_buy_size(members: DataFrame, facts: DataFrame, cv: float = 0.15) -> DataFrame:
    x = F.col("quote_amount")
    spread = (F.stddev_pop(x) / F.abs(F.avg(x))).alias("_cv")
    rows = _over(members, facts, x > 0, spread, _signatures("buy_signature", 10)).filter(F.col("_cv") <= cv)
    return _finding(rows, "BUY_SIZE_SIMILARITY", F.lit(None), F.col("wallets"), F.col("signatures"), F.lit(0.45))


def evidence_fresh(members: DataFrame, facts: DataFrame, seconds: float = 3600) -> DataFrame:
    rows = _over(members, facts, F.col("age_seconds") < seconds)
    return _finding(rows, "FRESH_WALLETS", F.lit(None), F.col("wallets"), F.expr(NONE), F.lit(0.4))


def evidence_repeat(members: DataFrame, recurring: DataFrame, parts: DataFrame, most: int = 4) -> DataFrame:
    """``recurring``: (mint, other_mint) pairs; the ``most`` largest groups per cluster are reported."""
    seen = parts.select(F.col("mint").alias("other_mint"), "wallet")
    rows = (
        members.join(recurring.select("mint", "other_mint"), "mint")
        .join(seen, ["other_mint", "wallet"], "left_semi")
        .groupBy(*KEYS, "other_mint")
        .agg(_wallets(), F.count(F.lit(1)).alias("n"))
        .filter("n >= 3")
    )
    w = Window.partitionBy(*KEYS).orderBy(F.col("n").desc(), "other_mint")
    rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    strength = F.least(F.lit(0.9), 0.45 + 0.1 * F.col("n"))
    return _finding(rows, "REPEATED_CO_PARTICIPATION", F.col("other_mint"), F.col("wallets"), F.expr(NONE), strength)


def evidence_creator(members: DataFrame, links: DataFrame) -> DataFrame:
    """``links``: (mint, creator, wallet)."""
    rows = members.join(links.select("mint", "wallet", "creator").distinct(), ["mint", "wallet"])
    rows = rows.groupBy(*KEYS, "creator").agg(_wallets())
    return _finding(rows, "CREATOR_LINK", F.col("creator"), F.col("wallets"), F.expr(NONE), F.lit(0.9))


def evidence_exit(exit_groups: DataFrame) -> DataFrame:
    """The largest synchronised exit of each cluster, from three members up."""
    best = F.max(F.struct("wallets", (-F.col("exit_group")).alias("g"), "members")).alias("_b")
    rows = exit_groups.filter("wallets >= 3").groupBy(*KEYS).agg(best)
    return _finding(rows, "EXIT_COORDINATION", F.lit(None), F.col("_b.members"), F.expr(NONE), F.lit(0.8))


def evidence_mayhem(clusters: DataFrame, mayhem: DataFrame, automated: DataFrame, listed: int = 20) -> DataFrame:
    w = Window.partitionBy("mint").orderBy("wallet")
    names = automated.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= listed)
    names = names.groupBy("mint").agg(F.array_sort(F.collect_list(F.col("wallet").cast("string"))).alias("wallets"))
    rows = clusters.select(*KEYS).distinct().join(mayhem.filter("enabled").select("mint"), "mint").join(names, "mint", "left")
    return _finding(rows, "MAYHEM_MODE", F.lit(None), F.coalesce("wallets", F.expr(NONE)), F.expr(NONE), F.lit(0.0))


def evidence(parts: list[DataFrame]) -> DataFrame:
    """All findings, strongest first per cluster; ``traceable`` ones cite a signature."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    emission = F.coalesce(*[F.when(F.col("code") == code, i) for i, code in enumerate(TEXTS)])
    w = Window.partitionBy(*KEYS).orderBy(F.col("strength").desc(), emission, "item")
    from mintweave.functions.scalars import text_of

    return (
        every.withColumn("rank", F.row_number().over(w))
        .withColumn("traceable", F.coalesce(F.size("signatures") > 0, F.lit(False)))
        .withColumn("title", text_of(F.col("code"), {k: v[0] for k, v in TEXTS.items()}))
        .withColumn("caveat", text_of(F.col("code"), {k: v[1] for k, v in TEXTS.items()}))
    )
