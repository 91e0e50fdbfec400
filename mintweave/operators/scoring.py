"""Scores, confidence and classification: column expressions over one row per cluster or launch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S


def _damping(name: str) -> Column:
    if name in ("common_funder", "common_intermediary"):
        return F.when(F.col("funder_is_infrastructure"), P.INFRA_DAMPING).otherwise(1.0)
    if name in ("buy_timing_similarity", "buy_amount_similarity"):
        return F.greatest(F.lit(0.0), 1.0 - F.col("mayhem_share"))
    return F.lit(1.0)


def bundle_score(rows: DataFrame) -> DataFrame:
    """Score a cluster from its signals and context, all columns of ``rows``.

    Adds ``contributions``, ``families`` (how many independent signal families
    fired), ``ceiling``, ``floor`` and ``bundle_score``.
    """
    parts = {
        f"_pt_{name}": F.lit(weight) * S.clamp(F.coalesce(name, F.lit(0.0))) * _damping(name)
        for name, (weight, _, _) in P.SIGNALS.items()
    }
    other_name, other_weight, other_label = P.OTHER_ANOMALIES
    parts["_pt_other"] = other_weight * (0.6 * S.clamp(F.col("fresh_share")) + 0.4 * S.clamp(F.col("sell_coordination")))
    rows = rows.withColumns(parts)
    points = {name: F.col(f"_pt_{name}") for name in P.SIGNALS}
    other = F.col("_pt_other")

    families: dict[str, list[str]] = {}
    for name, (_, family, _) in P.SIGNALS.items():
        families.setdefault(family, []).append(name)
    fired = F.lit(0)
    for names in families.values():
        top = sum(P.SIGNALS[n][0] for n in names)
        reached = points[names[0]]
        for n in names[1:]:
            reached = reached + points[n]
        fired = fired + F.when(reached / top >= P.FAMILY_FIRES_AT, 1).otherwise(0)

    def item(name: str, label: str, value: Column, most: float, raw: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"), F.lit(label).alias("label"), F.bround(value, 2).alias("points"), F.lit(most).alias("max_points"),
            F.bround(raw, 4).alias("raw_signal"),
        )

    items = [item(n, P.SIGNALS[n][2], points[n], P.SIGNALS[n][0], F.coalesce(n, F.lit(0.0))) for n in P.SIGNALS]
    items.append(item(other_name, other_label, other, other_weight, other / other_weight))
    scored = rows.withColumn("_items", F.array(*items)).withColumn("families", fired)
    total = F.lit(0.0)
    for value in [*points.values(), other]:
        total = total + F.bround(value, 2)
    limit = F.when(F.col("families") >= P.MIN_FAMILIES, F.lit(None).cast("double")).when(
        F.col("families") == P.MIN_FAMILIES - 1, P.TWO_FAMILY_CEILING
    ).otherwise(P.ONE_FAMILY_CEILING)
    scored = scored.withColumn("total_points", total).withColumn("ceiling", F.when(F.col("total_points") > limit, limit))
    lifted = (
        (F.col("atomic_size") >= 2)
        & (F.col("atomic_share") >= P.ATOMIC_SHARE)
        & (F.col("families") >= P.MIN_FAMILIES)
        & F.col("ceiling").isNull()
        & (F.col("total_points") < P.ATOMIC_FLOOR)
    )
    scored = scored.withColumn("floor", F.when(lifted, P.ATOMIC_FLOOR))
    final = F.coalesce("floor", "ceiling", "total_points")
    return scored.withColumn("bundle_score", S.half_even(S.clamp(final, 0.0, 100.0))).withColumn(
        "contributions", F.filter("_items", lambda x: (x["points"] > 0) | (x["raw_signal"] > 0))
    ).drop("_items", *parts)


def top_contributions(scored: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` largest contributions per cluster, one row each; a cluster's few parts are ordered in its row."""
    parts = F.filter("contributions", lambda c: c["points"] > 0)
    ordered = F.array_sort(F.transform(parts, lambda c, i: F.struct((-c["points"]).alias("k"), i.alias("i"), c.alias("c"))))
    # The outer form keeps the planner from copying the whole score expression into a size filter.
    rows = scored.select("mint", "cluster_id", F.posexplode_outer(F.slice(ordered, 1, n)).alias("_i", "_o")).filter("_o is not null")
    return rows.select("mint", "cluster_id", (F.col("_i") + 1).alias("rank"), *[F.col(f"_o.c.{x}").alias(x) for x in ("name", "label", "points", "max_points")])


def score_explanation(scored: DataFrame, n: int = 8) -> DataFrame:
    """Text lines of a score: its largest parts, then the floor or the ceiling."""
    parts = F.filter("contributions", lambda c: c["points"] > 0)
    ordered = F.slice(F.array_sort(F.transform(parts, lambda c, i: F.struct((-c["points"]).alias("k"), i.alias("i"), c["label"].alias("l")))), 1, n)
    lines = F.transform(ordered, lambda c: F.concat(F.lit("+"), F.bround(-c["k"]).cast("int").cast("string"), F.lit(" "), c["l"]))
    floor = F.when(F.col("floor").isNotNull(), F.concat(F.lit(f"raised to {P.ATOMIC_FLOOR:.0f}: "), F.col("atomic_size").cast("string"), F.lit(" buyers inside one transaction")))
    ceiling = F.when(
        F.col("ceiling").isNotNull(),
        F.concat(F.lit("capped at "), F.col("ceiling").cast("int").cast("string"), F.lit(": "), F.col("families").cast("string"), F.lit(" independent families fired")),
    )
    return scored.select("mint", "cluster_id", F.concat(lines, F.array_compact(F.array(floor, ceiling))).alias("lines"))


# --- component scores ----------------------------------------------------------------------


def funding_coordination() -> Column:
    c = F.col
    return S.scale_to_100(
        0.45 * c("common_funder") + 0.20 * c("common_intermediary") + 0.20 * c("funding_timing_similarity") + 0.15 * c("funding_amount_similarity")
    )


def buy_coordination() -> Column:
    return S.scale_to_100(0.6 * F.col("buy_timing_similarity") + 0.4 * F.col("buy_amount_similarity"))


def wallet_cluster_score() -> Column:
    size = F.least(F.lit(1.0), F.col("size") / 10.0)
    confirmed = F.when(F.col("method").contains("+"), 1.0).otherwise(0.8)
    return S.half_even(F.least(F.lit(100.0), F.col("bundle_score") * (0.7 + 0.3 * size) * confirmed))


def overall_risk() -> Column:
    c = F.col
    base = 0.50 * c("bundle_score") + 0.15 * c("wallet_cluster") + 0.15 * c("dev_risk") + 0.10 * c("early_buyer_risk") + 0.10 * c("sell_score")
    return S.half_even(S.clamp(base * (0.55 + 0.45 * (c("confidence") / 100.0)), 0.0, 100.0))


def worst_third_mean(wallets: DataFrame, keys: list[str]) -> DataFrame:
    """Mean risk of the worst third of the scored wallets (at least one)."""
    rows = wallets.filter(~S.is_infrastructure(F.col("entity_type")))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.col("risk_score").desc(), "wallet")
    ranked = rows.withColumn("_r", F.row_number().over(w)).join(n, keys)
    take = F.greatest(F.lit(1), F.floor(F.col("_n") / 3))
    return ranked.filter(F.col("_r") <= take).groupBy(*keys).agg(S.half_even(F.avg("risk_score")).alias("early_buyer_risk"))


def coordination_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Temporal coordination and the delay, funding, purchase and age summaries of a group."""
    from mintweave.operators.tape import describe_small

    c = F.col
    times = F.when(c("block_time").isNotNull(), c("block_time"))
    return rows.groupBy(*keys).agg(
        S.scale_to_100(S.timing_similarity(times, P.BUY_WINDOW)).alias("temporal"),
        (F.max(times) - F.min(times)).alias("span_seconds"),
        *describe_small(c("funding_to_buy_seconds"), "delay_"),
        *describe_small(S.known(c("funding_amount")), "funding_"),
        S.amount_similarity(S.known(c("funding_amount"))).alias("funding_similarity"),
        *describe_small(F.when(c("quote_amount") > 0, c("quote_amount")), "purchase_"),
        S.amount_similarity(F.when(c("quote_amount") > 0, c("quote_amount"))).alias("purchase_similarity"),
        *describe_small(c("age_seconds"), "age_"),
        S.amount_similarity(c("age_seconds"), P.AGE_CV_IDENTICAL, P.AGE_CV_UNRELATED).alias("age_similarity"),
    )


# --- confidence ---------------------------------------------------------------------------------


def coherence(names: list[str]) -> Column:
    """Sharp findings read as coherent, a grey smear as noise.

    Written as plain sums over the signal columns, so it stays inside generated
    code: the entropy of the kept values is ``ln T - sum(v ln v) / T``.
    """
    zero = F.lit(0.0)
    n, total, vlnv = F.lit(0), zero, zero
    for name in names:
        v, keep = F.col(name), F.col(name) > 0.05
        n = n + F.when(keep, 1).otherwise(0)
        total = total + F.when(keep, v).otherwise(zero)
        vlnv = vlnv + F.when(keep, v * F.ln(v)).otherwise(zero)
    entropy = (F.ln(total) - vlnv / total) / F.ln(n.cast("double"))
    blend = 0.6 * total / n + 0.4 * (1.0 - entropy)
    return F.when(n == 0, 0.0).when(n == 1, 0.35).otherwise(S.clamp(blend))


def contradictions() -> Column:
    """Facts that argue against coordination, as short codes."""
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("funder_is_infrastructure"), "shared funder is infrastructure"),
            F.when(c("mayhem_enabled"), "mayhem was active"),
            F.when(c("unobserved_share") > 0.4, "funding history unreadable for many wallets"),
            F.when(c("bounded_ages") > 0, "some wallet ages are lower bounds"),
            F.when((c("common_funder") == 0) & (c("buy_amount_similarity") > 0.8), "similar sizes without a shared funder"),
        )
    )


def data_quality(coverage: DataFrame, requests: DataFrame | None = None, keys: tuple[str, ...] = ("mint",)) -> DataFrame:
    """Coverage and provider scores per launch.

    ``coverage`` (keys, dimension, level); ``requests`` (keys, provider, ok, latency).
    """
    level = F.when(F.col("level") == "complete", 1.0).when(F.col("level") == "partial", 0.5).otherwise(0.0)
    out = coverage.groupBy(*keys).agg(F.avg(level).alias("coverage"))
    if requests is None:
        return out.withColumn("providers", F.lit(0.0)).withColumn("quality", F.col("coverage"))
    rates = provider_health(requests, keys).groupBy(*keys).agg(F.avg("success_rate").alias("providers"))
    out = out.join(rates, list(keys), "left")
    quality = F.when(F.col("providers").isNull(), F.col("coverage")).otherwise(0.5 * F.col("coverage") + 0.5 * F.col("providers"))
    return out.withColumn("quality", quality).withColumn("providers", F.coalesce("providers", F.lit(0.0)))


def provider_health(requests: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rate = 1.0 - F.count(F.when(~F.col("ok"), 1)) / F.count(F.lit(1))
    return requests.groupBy(*keys, "provider").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count(F.when(~F.col("ok"), 1)).alias("failures"),
        rate.alias("success_rate"),
        (F.avg("latency") * 1000.0).alias("avg_latency_ms"),
        F.when(rate < 0.5, "FAILED").when(rate <= 0.9, "DEGRADED").otherwise("OK").alias("status"),
    )


def confidence(rows: DataFrame) -> DataFrame:
    """Confidence from sample size, coverage, providers, coherence and history depth.

    Needs ``wallets_analyzed, coverage, providers, coherence, history_coverage``
    and the array ``contradictions``.
    """
    c = F.col
    middle = (P.LOW_DATA_WALLETS + P.HIGH_DATA_WALLETS) / 2.0
    sample = S.logistic_confidence(c("wallets_analyzed"), middle, 0.30)
    weighted = (
        0.30 * sample + 0.28 * S.clamp(c("coverage")) + 0.17 * S.clamp(c("providers")) + 0.15 * S.clamp(c("coherence"))
        + 0.10 * S.clamp(c("history_coverage"))
    )
    penalty = F.least(F.lit(0.35), 0.12 * F.size("contradictions"))
    small = c("wallets_analyzed") < P.LOW_DATA_WALLETS
    own = F.array_compact(
        F.array(
            F.when(small, "too few wallets for a group judgement"),
            F.when(c("coverage") < 0.7, "data coverage is incomplete"),
            F.when(c("providers") < 0.9, "a data source failed often"),
            F.when(c("history_coverage") < 0.5, "history look-back was shallow"),
        )
    )
    # One step per column: a limit names its argument twice, so nesting them would
    # double the expression at every level.
    return (
        rows.withColumn("_weighted", weighted - penalty)
        .withColumn("_raw", S.clamp(c("_weighted")))
        .withColumn("_capped", F.when(small, F.least(c("_raw"), F.lit(P.SMALL_SAMPLE_CEILING))).otherwise(c("_raw")))
        .withColumn("confidence", S.scale_to_100(c("_capped")))
        .withColumn("confidence_level", S.confidence_level(c("confidence")))
        .withColumn("limitations", F.concat(own, "contradictions"))
        .drop("_weighted", "_raw", "_capped")
    )


def classification() -> Column:
    """First reading that fits; benign explanations come first."""
    c = F.col
    return (
        F.when((c("members") < P.MIN_CLUSTER_SIZE) | (c("confidence") < 25), "INSUFFICIENT DATA")
        .when(c("mayhem_enabled") & (c("mayhem_activity") >= 50), "MAYHEM ACTIVITY")
        .when(c("funder_is_infrastructure") & (c("families") <= 1), "CEX-FUNDED USERS")
        .when((c("same_slot_wallets") >= 3) & (c("common_funder") < 0.2) & (c("common_intermediary") < 0.2), "MEV / AUTOMATED ACTIVITY")
        .when((c("experienced_share") >= P.SNIPER_SHARE) & (c("common_funder") < 0.3) & (c("creator_linkage") == 0), "PROFESSIONAL SNIPERS")
        .when((c("bundle_score") >= 70) & (c("families") >= P.MIN_FAMILIES), "BUNDLE-LIKE PATTERN")
        .when(c("bundle_score") >= 45, "POSSIBLE COORDINATION")
        .otherwise("NORMAL EARLY BUYERS")
    )


def risk_report(rows: DataFrame) -> DataFrame:
    """The eleven scores, confidence, classification and level of each row (launch or cluster)."""
    c = F.col
    out = (
        rows.withColumn("funding_coordination", funding_coordination())
        .withColumn("buy_coordination", buy_coordination())
        .withColumn("wallet_cluster", F.when(c("size").isNull(), 0).otherwise(wallet_cluster_score()))
        .withColumn("creator_link", S.scale_to_100(c("creator_linkage")))
        .withColumn("historical_pattern", S.scale_to_100(c("historical_overlap")))
        .withColumn("sell_score", S.scale_to_100(c("sell_coordination")))
    )
    out = out.withColumn("overall_risk", overall_risk())
    return out.withColumn("classification", classification()).withColumn("risk_level", S.risk_level(c("overall_risk"))).withColumn(
        "verdict", S.text_of(F.col("classification"), S.VERDICTS)
    )


def scan_warnings(complete_history: Column, mayhem: Column, state: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~complete_history, "trade history is incomplete; the earliest buyers may be missing"),
            F.when(mayhem, "mayhem mode: part of the early activity may be automated"),
            F.when(state == "CREATED", "no trades yet"),
        )
    )
