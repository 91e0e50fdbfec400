"""Per-wallet facts: age, balances, history, risk, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators.skew import first_n

TX_ORDER = ["block_time", "slot", "signature"]


def _newest_first(columns=TX_ORDER):
    return [F.col(c).desc() for c in columns]


def latest_n_before(wallet_tx: DataFrame, cursors: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` entries strictly older than each address's cursor signature."""
    mark = wallet_tx.join(cursors.select("address", "signature"), ["address", "signature"]).select(
        "address", F.struct(*TX_ORDER).alias("_cursor")
    )
    older = wallet_tx.join(mark, "address").filter(F.struct(*TX_ORDER) < F.col("_cursor")).drop("_cursor")
    return first_n(older, ["address"], _newest_first(), n)


def newest_page(wallet_tx: DataFrame, n: int, since: int | None = None) -> DataFrame:
    """Newest ``n`` entries per address, stopping at a time floor."""
    rows = wallet_tx if since is None else wallet_tx.filter(F.col("block_time") >= since)
    return first_n(rows, ["address"], _newest_first(), n)


def oldest_activity(wallet_tx: DataFrame) -> DataFrame:
    first = F.min(F.struct(*TX_ORDER))
    return wallet_tx.groupBy("address").agg(first.alias("_f")).select("address", "_f.*")


def current_balances(sol: DataFrame) -> DataFrame:
    """Balance of each address after its newest transaction, in whole units."""
    last = F.max(F.struct("block_time", "slot", "signature", "post"))
    return sol.groupBy("address").agg(last.alias("_l")).select(
        "address", (F.col("_l.post") / F.lit(float(P.LAMPORTS))).alias("balance")
    )


def wallet_age(
    first_buys: DataFrame, launches: DataFrame, wallet_tx: DataFrame, page_cap: int | None = None
) -> DataFrame:
    """Age of each buyer at its first buy, and whether that buy was its first action.

    With ``page_cap`` only the newest ``page_cap`` entries count and a full page
    makes the age a lower bound; by default the whole history is read.
    """
    wallet_tx = wallet_tx.join(first_buys.select(F.col("wallet").alias("address")).distinct(), "address", "left_semi")
    rows = wallet_tx if page_cap is None else newest_page(wallet_tx, page_cap)
    seen = rows.groupBy(F.col("address").alias("wallet")).agg(
        F.min("block_time").alias("first_seen"), F.count(F.lit(1)).alias("signatures")
    )
    bounded = F.lit(False) if page_cap is None else F.coalesce(F.col("signatures") >= page_cap, F.lit(False))
    buys = first_buys.select("mint", "wallet", "block_time").join(launches.select("mint", "created_at"), "mint", "left")
    reference = F.coalesce(S.known(F.col("block_time")), F.col("created_at"))
    age = (reference - F.col("first_seen")).cast("double")
    return buys.join(seen, "wallet", "left").select(
        "mint",
        "wallet",
        "first_seen",
        F.coalesce("signatures", F.lit(0)).cast("long").alias("signatures"),
        bounded.alias("age_bounded"),
        F.when(age.isNotNull(), F.greatest(F.lit(0.0), age)).alias("age_seconds"),
        F.coalesce(F.abs(F.col("block_time") - F.col("first_seen")) <= 1, F.lit(False)).alias("first_action"),
    )


def fresh_bucket_counts(profiles: DataFrame) -> DataFrame:
    """Wallets per age bucket, zero-filled, with the unknown ones counted apart."""
    bucket = F.coalesce(S.fresh_bucket(F.col("age_seconds")), F.lit("unknown"))
    labels = [label for label, _ in P.FRESH_BUCKETS] + [P.FRESH_OLDEST, "unknown"]
    return profiles.groupBy("mint").agg(*[F.count(F.when(bucket == label, 1)).alias(label) for label in labels])


# --- history over other launches ---------------------------------------------------------


def participation(trades: DataFrame, initial: int | None = P.INITIAL_REAL_TOKENS) -> DataFrame:
    """Per (wallet, mint): trades and how early into the curve they came.

    Depth classes exclude each other and count trades, sells included.
    """
    depth = S.entry_depth(F.col("real_token_reserves"), F.lit(initial).cast("long"))
    ultra, early = depth <= P.DEPTH_ULTRA, (depth > P.DEPTH_ULTRA) & (depth <= P.DEPTH_EARLY)
    moderate = (depth > P.DEPTH_EARLY) & (depth <= P.DEPTH_MODERATE)
    return trades.groupBy("wallet", "mint").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count(F.when(ultra, 1)).alias("ultra_early"),
        F.count(F.when(early, 1)).alias("early"),
        F.count(F.when(moderate, 1)).alias("moderate"),
        F.min("block_time").alias("first_time"),
        F.max("block_time").alias("last_time"),
    )


_COUNTS = ("trades", "ultra_early", "early", "moderate")


def _history_totals(parts: DataFrame) -> DataFrame:
    return parts.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("launches"), *[F.sum(c).alias(c) for c in _COUNTS], F.min("first_time").alias("first_seen")
    )


def wallet_history_class(launches, ultra_early):
    ratio = F.when(launches > 0, ultra_early / launches).otherwise(0.0)
    return (
        F.when(launches == 0, "NO HISTORY")
        .when((launches >= 20) & (ratio >= 0.4), "EARLY-LAUNCH SPECIALIST")
        .when(launches >= 20, "RECURRING LAUNCH TRADER")
        .when(launches >= 5, "OCCASIONAL LAUNCH TRADER")
        .otherwise("OCCASIONAL TRADER")
    )


def wallet_history(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Track record of each (mint, wallet) on *other* launches: wallet totals minus this launch's row."""
    own = parts.select("mint", "wallet", *[F.col(c).alias(f"_own_{c}") for c in _COUNTS])
    joined = members.select("mint", "wallet").join(_history_totals(parts), "wallet", "left").join(own, ["mint", "wallet"], "left")
    here = F.when(F.col("_own_trades").isNotNull(), 1).otherwise(0)

    def rest(total, own_value):
        return (F.coalesce(total, F.lit(0)) - F.coalesce(own_value, F.lit(0))).cast("long")

    out = joined.select(
        "mint",
        "wallet",
        rest(F.col("launches"), here).alias("launches"),
        *[rest(F.col(c), F.col(f"_own_{c}")).alias(c) for c in _COUNTS],
        "first_seen",
    )
    return out.withColumn("history_class", wallet_history_class(F.col("launches"), F.col("ultra_early")))


# --- per-wallet risk -------------------------------------------------------------------------


def early_buyer_risk(profiles: DataFrame) -> DataFrame:
    """0-100 risk per buyer with its reasons; infrastructure is never scored as a user."""
    age, delay = F.col("age_seconds"), F.col("funding_to_buy_seconds")
    entry, past = F.col("seconds_after_launch"), F.col("launches")
    rules = [
        (age < 60, 25, "wallet under a minute old"),
        ((age >= 60) & (age < 600), 18, "wallet under ten minutes old"),
        ((age >= 600) & (age < 86400), 8, "wallet under a day old"),
        (delay <= 10, 22, "funded within ten seconds of buying"),
        ((delay > 10) & (delay <= 120), 12, "funded within two minutes of buying"),
        (F.col("first_action"), 15, "first action on chain"),
        (entry <= 5, 18, "bought within five seconds"),
        ((entry > 5) & (entry <= 30), 10, "bought within thirty seconds"),
        (past >= 20, 10, "traded twenty or more launches before"),
    ]
    points = sum((F.when(rule, n).otherwise(0) for rule, n, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(text)) for rule, _, text in rules]))
    infra = S.is_infrastructure(F.col("entity_type"))
    return profiles.withColumn("risk_score", F.when(infra, 0).otherwise(F.least(F.lit(100), points)).cast("int")).withColumn(
        "risk_reasons", F.when(infra, F.array(F.lit("infrastructure, not scored"))).otherwise(reasons)
    )


def balance_after_purchase(balance_after_funding, amount):
    left = balance_after_funding - amount
    return F.when(left.isNotNull(), F.greatest(F.lit(0.0), left))


# --- behaviour fingerprints --------------------------------------------------------------------

FINGERPRINT = ("age", "funding", "entry_timing", "entry_size", "holding", "sells", "frequency")


def wallet_fingerprint(profiles: DataFrame) -> DataFrame:
    """Seven behaviour buckets per (mint, wallet)."""
    return profiles.select(
        "mint",
        "wallet",
        S.age_bucket(F.col("age_seconds")).alias("age"),
        S.amount_bucket(F.col("funding_amount")).alias("funding"),
        S.entry_bucket(F.col("seconds_after_launch")).alias("entry_timing"),
        S.amount_bucket(F.col("quote_amount")).alias("entry_size"),
        S.hold_bucket(F.col("hold_seconds")).alias("holding"),
        S.sell_behavior(F.col("sold_fraction"), F.col("has_sells")).alias("sells"),
        S.frequency_bucket(F.col("launches")).alias("frequency"),
    )


def fingerprint_classes(prints: DataFrame) -> DataFrame:
    """Wallets per distinct fingerprint of a launch: the buckets bound the number of classes."""
    return prints.groupBy("mint", *FINGERPRINT).agg(F.count(F.lit(1)).alias("wallets"))


def fingerprint_pairs(prints: DataFrame, min_equal: int = 5) -> DataFrame:
    """Similarity of fingerprint classes within a launch, for pairs agreeing on ``min_equal`` of 7 buckets.

    Works on classes, not wallets: every pair of wallets has the similarity of
    its pair of classes, so the result is whole without listing wallet pairs.
    Two classes that differ in at most ``7 - min_equal`` buckets agree on one of
    ``8 - min_equal`` disjoint bucket groups, which is what they are joined on.
    """
    classes = fingerprint_classes(prints).withColumn("class", F.concat_ws("/", *FINGERPRINT))
    parts = 8 - min_equal
    groups = [FINGERPRINT[i::parts] for i in range(parts)]
    keyed = classes.withColumn(
        "_key", F.explode(F.array(*[F.concat_ws("/", F.lit(str(i)), *g) for i, g in enumerate(groups)]))
    )
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.mint") == F.col("b.mint")) & (F.col("a._key") == F.col("b._key")) & (F.col("a.class") < F.col("b.class"))
    equal = sum((F.when(F.col(f"a.{c}") == F.col(f"b.{c}"), 1).otherwise(0) for c in FINGERPRINT), F.lit(0))
    found = (
        a.join(b, on)
        .select(
            F.col("a.mint").alias("mint"), F.col("a.class").alias("class_a"), F.col("b.class").alias("class_b"),
            F.col("a.wallets").alias("wallets_a"), F.col("b.wallets").alias("wallets_b"), equal.alias("_equal"),
        )
        .filter(F.col("_equal") >= min_equal)
        .distinct()
        .withColumn("similarity", F.col("_equal") / 7.0)
        .drop("_equal")
    )
    same = classes.filter("wallets > 1").select(
        "mint", F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.col("wallets").alias("wallets_a"),
        F.col("wallets").alias("wallets_b"), F.lit(1.0).alias("similarity"),
    )
    return found.unionByName(same)
