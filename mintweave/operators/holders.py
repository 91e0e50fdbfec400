"""Who holds a token and how concentrated it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.functions import scalars as S
from mintweave.operators.skew import first_n, value_ranks

# Full lists first; the last source knows the top 20 accounts only.
PROVIDERS = (("helius", "complete"), ("solscan", "complete"), ("rpc", "partial"))


def biggest_first():
    return [F.col("amount").desc(), F.col("owner")]


def holders_by_priority(holders: DataFrame, mints: DataFrame, limit: int | None = 50) -> DataFrame:
    """Holders from the first source that listed any, with the coverage that source gives.

    ``None`` keeps all of them, without a position.
    """
    rank = F.coalesce(*[F.when(F.col("provider") == name, i) for i, (name, _) in enumerate(PROVIDERS)])
    listed = holders.filter("owner is not null and amount > 0").withColumn("_p", rank)
    best = listed.groupBy("mint").agg(F.min("_p").alias("_p"))
    level = F.coalesce(*[F.when(F.col("_p") == i, cover) for i, (_, cover) in enumerate(PROVIDERS)])
    chosen = listed.join(best, ["mint", "_p"]).withColumn("coverage", level)
    if limit is None:
        top = chosen.withColumn("position", F.lit(None).cast("int"))
    else:
        top = first_n(chosen, ["mint"], biggest_first(), limit)
    none = mints.select("mint").join(best, "mint", "left_anti").withColumn("coverage", F.lit("missing"))
    return top.select("mint", "owner", "amount", "provider", "position", "coverage").unionByName(none, allowMissingColumns=True)


def excluded_holders(labelled: DataFrame, infra: DataFrame | None = None) -> DataFrame:
    """Holder rows that are protocol accounts, with the reason.  ``labelled`` carries entity_type and label."""
    out = _flagged(labelled, infra).filter("_out")
    return out.select("mint", "owner", "amount", F.coalesce("label", F.lit("protocol account")).alias("reason"))


def _flagged(labelled: DataFrame, infra: DataFrame | None) -> DataFrame:
    rows = labelled.filter("owner is not null and amount > 0")
    mark = S.is_infrastructure(F.col("entity_type"))
    if infra is not None:
        rows = rows.join(infra.select("mint", "owner", F.lit(True).alias("_listed")), ["mint", "owner"], "left")
        mark = mark | F.col("_listed").isNotNull()
    return rows.withColumn("_out", mark)


def top_holders(labelled: DataFrame, n: int = 50, infra: DataFrame | None = None) -> DataFrame:
    return first_n(_flagged(labelled, infra).filter("not _out"), ["mint"], biggest_first(), n).select("mint", "owner", "amount", "position")


def gini(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inequality per group, exact for groups of any size (equal values count as one block)."""
    kept = df.filter(F.col(value) >= 0)
    ranks = value_ranks(kept, keys, value)
    v, c, b = F.col(value), F.col("copies"), F.col("below")
    block = v * (c * b + c * (c + 1) / 2.0)  # sum of the 1-based ranks of c equal values
    sums = ranks.groupBy(*keys).agg(F.sum(block).alias("_w"), F.sum(v * c).alias("_t"), F.sum("copies").alias("_n"))
    n = F.col("_n")
    return sums.select(
        *keys, F.when(F.col("_t") > 0, 2.0 * F.col("_w") / (n * F.col("_t")) - (n + 1.0) / n).otherwise(0.0).alias("gini")
    )


def holder_concentration(labelled: DataFrame, infra: DataFrame | None = None) -> DataFrame:
    """Totals, top-1/5/10 shares and inequality, protocol accounts left out."""
    kept = _flagged(labelled, infra).filter("not _out").select("mint", "owner", "amount")
    totals = kept.groupBy("mint").agg(F.sum("amount").alias("total_held"), F.count(F.lit(1)).alias("holder_count"))
    head = first_n(kept, ["mint"], biggest_first(), 10).groupBy("mint").agg(
        *[F.sum(F.when(F.col("position") <= k, F.col("amount"))).alias(f"_top{k}") for k in (1, 5, 10)]
    )
    out = totals.join(head, "mint").join(gini(kept, ["mint"], "amount"), "mint")
    shares = [(F.col(f"_top{k}") / F.col("total_held")).alias(f"top_{k}_share") for k in (1, 5, 10)]
    return out.select("mint", "total_held", "holder_count", *shares, "gini")
