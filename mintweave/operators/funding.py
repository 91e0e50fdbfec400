"""Where buyers' money came from: inflows, the operative funding before the first buy, multi-hop paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators.entities import assess_funders, fanout, scope_keys
from mintweave.operators.skew import DAY, last_before
from mintweave.session import cut

ORDER = ["block_time", "slot"]
TIES = ["signature", "source"]


def inflow_events(sol: DataFrame, tokens: DataFrame, min_sol: float = P.MIN_SOL_INFLOW, min_usdc: float = P.MIN_USDC_INFLOW) -> DataFrame:
    """Value inflows per (transaction, address): SOL if it matters, else USDC.

    The payer is whoever lost most in the same transaction.  A recipient gained,
    so it is never among the payers.  One transaction names a bounded number of
    accounts, so the per-transaction window stays small.
    """
    tx = Window.partitionBy("signature")

    def payer(who: str, when=F.lit(True)):
        loss = F.when((F.col("delta") < 0) & when, F.struct("delta", F.col(who).alias("who")))
        return F.min(loss).over(tx)["who"]

    sol_rows = (
        sol.filter("success")
        .withColumn("source", payer("address"))
        .withColumn("amount", F.col("delta") / F.lit(float(P.LAMPORTS)))
        .filter(F.col("amount") >= min_sol)
        .select(
            "source",
            F.col("address").alias("recipient"),
            F.lit("SOL").alias("asset"),
            "amount",
            "signature",
            "slot",
            "block_time",
            (F.col("pre") / F.lit(float(P.LAMPORTS))).alias("recipient_before"),
            (F.col("post") / F.lit(float(P.LAMPORTS))).alias("recipient_after"),
        )
    )
    usdc_rows = (
        tokens.filter(F.col("success") & (F.col("mint") == S.USDC))
        .withColumn("source", payer("owner"))
        .withColumn("amount", F.col("delta") / F.lit(1e6))
        .filter(F.col("amount") >= min_usdc)
        .select(
            "source",
            F.col("owner").alias("recipient"),
            F.lit("USDC").alias("asset"),
            "amount",
            "signature",
            "slot",
            "block_time",
            F.lit(None).cast("double").alias("recipient_before"),
            F.lit(None).cast("double").alias("recipient_after"),
        )
    )
    second = usdc_rows.join(sol_rows.select("signature", "recipient"), ["signature", "recipient"], "left_anti")
    return sol_rows.unionByName(second)


MONEY = ["source", "recipient", "asset", "amount", "signature", *ORDER]


ROUTE = ["source", "recipient", "signature", *ORDER]


def money(transfers: DataFrame, columns: list[str] = MONEY) -> DataFrame:
    """The columns of ``transfers`` that paths and groups read, written once for all as-of joins; no balances.

    ``ROUTE`` is enough where only who paid whom is asked for; the funding made from it has no amounts.
    """
    return cut(transfers.select(*columns), "money")


def upstream_of(transfers: DataFrame) -> DataFrame:
    """Newest inflow with a known source into each address (no time bound)."""
    newest = F.max(F.struct(*ORDER, *TIES, "amount"))
    return (
        transfers.filter(F.col("source").isNotNull())
        .groupBy(F.col("recipient").alias("address"))
        .agg(newest.alias("_m"))
        .select("address", F.col("_m.source").alias("parent"), "_m.amount", "_m.block_time", "_m.signature")
    )


def asof_funding(
    first_buys: DataFrame,
    transfers: DataFrame,
    other_tx: DataFrame | None = None,
    lookback: int | None = P.LOOKBACK,
    width: int = 30 * DAY,
) -> DataFrame:
    """Operative funding of each (mint, wallet): the newest inflow strictly before its first buy.

    Only the wallet's newest ``lookback`` transactions count.  ``other_tx``
    (``wallet_tx`` rows that are not inflows) fill up that look-back; without it
    the transfers alone do.
    """
    # Written once: it is read for the keys' sizes and for the join, and making it reads the whole tape.
    buys = cut(first_buys.select("mint", "wallet", *ORDER), "buys")
    details = [b for b in ("asset", "amount", "recipient_before", "recipient_after") if b in transfers.columns]
    rows = transfers.select(
        F.col("recipient").alias("wallet"), *ORDER, "signature", "source", *details, F.lit(True).alias("_inflow"),
    )
    if other_tx is not None:
        # all addresses in one exchange: leaving out those that did not buy would send every row through one more
        plain = other_tx.filter("err is null").select(F.col("address").alias("wallet"), *ORDER, "signature", F.lit(False).alias("_inflow"))
        rows = rows.unionByName(plain, allowMissingColumns=True)
    hits = last_before(
        buys,
        rows,
        on="wallet",
        order=ORDER,
        ties=TIES,
        payload=["source", "signature", "block_time", "slot", *details],
        usable=None if other_tx is None else F.col("_inflow"),
        lookback=lookback,
        shadow="signature",
        width=width,
    )
    h = F.col("hit")

    def detail(name, kind):
        return h[name] if name in details else F.lit(None).cast(kind)

    return hits.select(
        "mint",
        "wallet",
        h["source"].alias("direct_funder"),
        detail("amount", "double").alias("funding_amount"),
        h["block_time"].alias("funding_time"),
        h["slot"].alias("funding_slot"),
        h["signature"].alias("funding_signature"),
        (F.col("block_time") - h["block_time"]).cast("double").alias("funding_to_buy_seconds"),
        detail("asset", "string").alias("asset"),
        detail("recipient_before", "double").alias("balance_before_funding"),
        detail("recipient_after", "double").alias("balance_after_funding"),
        F.col("_seen_any").alias("observed"),
        h.isNotNull().alias("found"),
    )


def fee_payer_fallback(funding: DataFrame, first_buys: DataFrame, sol: DataFrame) -> DataFrame:
    """Wallets without any inflow whose first buy another address paid: that address is the funder.

    ``sol`` holds balance changes of the buy transactions (signature, address, delta).
    """
    paid = first_buys.filter(F.col("fee_payer").isNotNull() & (F.col("fee_payer") != F.col("wallet"))).select(
        "mint", "wallet", "fee_payer", F.col("signature").alias("_sig"), F.col("block_time").alias("_t"), F.col("slot").alias("_slot")
    )
    missing = funding.filter("not found").join(paid, ["mint", "wallet"])
    change = sol.groupBy(F.col("signature").alias("_sig"), F.col("address").alias("fee_payer")).agg(F.sum("delta").alias("_delta"))
    filled = missing.join(change, ["_sig", "fee_payer"], "left").select(
        "mint",
        "wallet",
        F.col("fee_payer").alias("direct_funder"),
        (F.abs(F.coalesce("_delta", F.lit(0))) / F.lit(float(P.LAMPORTS))).alias("funding_amount"),
        F.col("_t").alias("funding_time"),
        F.col("_slot").alias("funding_slot"),
        F.col("_sig").alias("funding_signature"),
        F.lit(0.0).alias("funding_to_buy_seconds"),
        F.lit("SOL").alias("asset"),
        "balance_before_funding",
        "balance_after_funding",
        F.lit(True).alias("observed"),
        F.lit(True).alias("found"),
    )
    kept = funding.join(filled.select("mint", "wallet"), ["mint", "wallet"], "left_anti")
    return kept.unionByName(filled)


def funding_paths(
    funding: DataFrame,
    transfers: DataFrame,
    assessment: DataFrame,
    scope: str = "global",
    max_hops: int = P.MAX_HOPS,
    causal: bool = True,
    width: int = 30 * DAY,
    kinds: bool = True,
) -> DataFrame:
    """Follow each direct funder upstream for up to ``max_hops`` hops.

    Stops at exchanges and other infrastructure, where the parent is unknown,
    and at cycles.  ``causal`` takes only inflows older than the payment they
    explain; otherwise the newest inflow of the address.  Without ``kinds`` the
    roots are not looked up (no ``root_type``).
    """
    keys = scope_keys(scope)
    stop = assessment.filter(S.is_infrastructure(F.col("entity_type"))).select(*keys, F.lit(True).alias("_stop"))
    chains = funding.filter(F.col("direct_funder").isNotNull()).select(
        "mint",
        "wallet",
        F.array("direct_funder").alias("chain"),
        F.col("direct_funder").alias("address"),
        F.col("funding_time").alias("block_time"),
        F.col("funding_slot").alias("slot"),
        F.lit(True).alias("_open"),
    )
    parents = transfers.filter(F.col("source").isNotNull()).select(
        F.col("recipient").alias("address"), *ORDER, "signature", "source"
    )
    # addresses that anybody paid: a chain that reaches another one is finished
    paid = cut(parents.select("address").distinct(), "paid") if causal else None
    newest = None if causal else upstream_of(transfers).select(
        "address", F.struct(F.col("parent").alias("source"), F.col("block_time"), F.lit(0).cast("long").alias("slot")).alias("hit")
    )
    for hop in range(max_hops - 1):
        if causal:
            # Each hop reaches fewer addresses; only they and their inflows enter the as-of join.
            if hop:
                chains = cut(chains, "chains")
            wanted = cut(chains.filter("_open").select("address").distinct().join(paid, "address", "left_semi"), "wanted")
            if wanted.isEmpty():
                break
        # Finished chains go around the as-of join instead of through it; the state of
        # each hop is written once because both branches read it.
        marked = chains.join(stop, keys, "left").withColumn("_open", F.col("_open") & F.col("_stop").isNull()).drop("_stop")
        marked = cut(marked, "hop")
        if causal:
            marked = marked.join(wanted.withColumn("_paid", F.lit(True)), "address", "left").withColumn("_open", F.col("_open") & F.col("_paid").isNotNull()).drop("_paid")
            stepped = last_before(
                marked.filter("_open"), parents.join(wanted, "address", "left_semi"), on="address", order=ORDER, ties=TIES, payload=["source", *ORDER], width=width
            )
        else:
            stepped = marked.filter("_open").join(newest, "address", "left")
        grows = F.col("hit").isNotNull() & ~F.array_contains("chain", F.coalesce("hit.source", F.lit("")))
        stepped = stepped.select(
            "mint",
            "wallet",
            F.when(grows, F.array_append("chain", F.col("hit.source"))).otherwise(F.col("chain")).alias("chain"),
            F.when(grows, F.col("hit.source")).otherwise(F.col("address")).alias("address"),
            F.when(grows, F.col("hit.block_time")).otherwise(F.col("block_time")).alias("block_time"),
            F.when(grows, F.col("hit.slot")).otherwise(F.col("slot")).alias("slot"),
            grows.alias("_open"),
        )
        chains = stepped.unionByName(marked.filter("not _open").select(*stepped.columns))
    path = F.array_append(F.reverse("chain"), F.col("wallet")).alias("path")
    if not kinds:
        return chains.select("mint", "wallet", path, F.col("address").alias("root"), F.size("chain").alias("hops"))
    kind = assessment.select(*keys, F.col("entity_type").alias("_root_type"))
    return chains.join(kind, keys, "left").select(
        "mint",
        "wallet",
        path,
        F.col("address").alias("root"),
        F.coalesce("_root_type", F.lit("FUNDER")).alias("root_type"),
        F.size("chain").alias("hops"),
    )


def funder_members(funding: DataFrame) -> DataFrame:
    """(mint, source, wallet) by direct funder; ``funding`` has one row per (mint, wallet), so these differ."""
    return funding.filter(F.col("direct_funder").isNotNull()).select("mint", F.col("direct_funder").alias("source"), "wallet")


def intermediary_members(paths: DataFrame) -> DataFrame:
    """(mint, source, wallet) for every path node above the wallet; a wallet of a launch has one path, so these differ."""
    above = F.array_distinct(F.slice("path", F.lit(1), F.size("path") - 1))
    return paths.select("mint", F.explode(above).alias("source"), "wallet")


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("mint", "source").agg(F.count(F.lit(1)).alias("wallets"))


def largest_funder_group(members: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Biggest funder group per launch; the lowest address wins a tie."""
    if excluded is not None:
        members = members.join(excluded.select("source").distinct(), "source", "left_anti")
    sizes = group_sizes(members)
    best = F.min(F.struct((-F.col("wallets")).alias("k"), F.col("source")))
    return sizes.groupBy("mint").agg(best.alias("_b")).select("mint", F.col("_b.source").alias("source"), (-F.col("_b.k")).alias("wallets"))


def funding_coverage(funding: DataFrame) -> DataFrame:
    share = F.avg(F.col("observed").cast("double"))
    return funding.groupBy("mint").agg(
        share.alias("coverage"),
        F.when(share >= 0.8, "complete").when(share > 0.2, "partial").otherwise("missing").alias("level"),
    )


def assess_sources(
    members: DataFrame, entities: DataFrame, activities: DataFrame | None = None,
    provider_labels: DataFrame | None = None, scope: str = "global", **thresholds,
) -> DataFrame:
    """Assessment of every source in a (mint, source, wallet) table, with the fan-out seen in it."""
    pairs = members.select("mint", F.col("source").alias("address"), F.col("wallet").alias("recipient"))
    return assess_funders(
        pairs, entities, fanout(pairs, scope), activities, provider_labels, scope=scope, **thresholds
    )


def split_by_assessment(members: DataFrame, assessment: DataFrame, scope: str = "global") -> tuple[DataFrame, DataFrame]:
    """Private groups and shared-infrastructure groups; a source without assessment is private."""
    keys = scope_keys(scope)
    judged = assessment.select(*[F.col(k).alias("source" if k == "address" else k) for k in keys], "weight", "shared")
    on = ["mint", "source"] if scope == "mint" else ["source"]
    out = members.join(judged, on, "left").select(
        "mint", "source", "wallet", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("shared", F.lit(False)).alias("shared")
    )
    return out.filter("not shared").drop("shared"), out.filter("shared").drop("shared")
