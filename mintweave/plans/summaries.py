"""Point look-ups computed for every address or launch at once; the caller filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.functions import scalars as S
from mintweave.operators import creator as C
from mintweave.operators import tape as T
from mintweave.operators import wallets as W
from mintweave.operators.entities import classify_entities
from mintweave.operators.skew import first_n


def wallet_summary(trades: DataFrame, wallet_tx: DataFrame, sol: DataFrame, entities: DataFrame, sampled: int = 12) -> DataFrame:
    """Balance, first action, transaction count, label and track record of every wallet."""
    totals = W.participation(trades).groupBy("wallet").agg(F.count(F.lit(1)).alias("launches"), F.sum("ultra_early").alias("ultra_early"))
    seen = wallet_tx.groupBy(F.col("address").alias("wallet")).agg(F.min("block_time").alias("first_seen"), F.count(F.lit(1)).alias("transactions"))
    named = first_n(trades.select("wallet", "mint").distinct(), ["wallet"], ["mint"], sampled).groupBy("wallet").agg(
        F.array_sort(F.collect_list("mint")).alias("sampled_launches")
    )
    labelled = classify_entities(seen.select(F.col("wallet").alias("address")), entities).select(F.col("address").alias("wallet"), "entity_type", "label")
    balances = W.current_balances(sol).withColumnRenamed("address", "wallet")
    out = seen.join(totals, "wallet", "left").join(balances, "wallet", "left").join(labelled, "wallet").join(named, "wallet", "left")
    out = out.fillna({"launches": 0, "ultra_early": 0})
    return out.withColumn("history_class", W.wallet_history_class(F.col("launches"), F.col("ultra_early")))


def creator_summary(launches: DataFrame, checked: int = 20, listed: int = 10) -> DataFrame:
    """Launches, graduations among the newest ``checked``, and the newest ``listed`` of every creator."""
    total = launches.groupBy("creator").agg(F.count(F.lit(1)).alias("launches"))
    newest = first_n(launches.select("creator", "mint", "created_at", "curve_complete"), ["creator"], C.newest_launch_first(), checked)
    head = newest.groupBy("creator").agg(
        F.count(F.when(F.col("curve_complete"), 1)).alias("graduated"),
        F.array_sort(F.collect_list(F.when(F.col("position") <= listed, F.struct("position", "mint")))).alias("_r"),
    )
    return total.join(head, "creator").select("creator", "launches", "graduated", F.transform("_r", lambda x: x["mint"]).alias("recent_launches"))


def wallet_activity(trades: DataFrame, listed: int = 12) -> DataFrame:
    """Launches, trades, depth classes, class and the newest trades of every wallet."""
    parts = W.participation(trades)
    totals = parts.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("launches"), *[F.sum(c).alias(c) for c in ("trades", "ultra_early", "early", "moderate")]
    )
    order = [F.col(c).desc() for c in ("block_time", "slot", "signature", "leg", "mint", "token_amount", "quote_amount")]
    newest = first_n(trades, ["wallet"], order, listed).groupBy("wallet").agg(
        F.array_sort(F.collect_list(F.struct("position", "mint", "is_buy", "quote_amount"))).alias("recent")
    )
    return totals.withColumn("history_class", W.wallet_history_class(F.col("launches"), F.col("ultra_early"))).join(newest, "wallet")


def launch_profile(launches: DataFrame, trades: DataFrame, as_of: int) -> DataFrame:
    """Token facts: pair, curve, mayhem, graduation, lifecycle."""
    flagged = trades.groupBy("mint").agg(F.count(F.when(F.col("mayhem"), 1)).alias("_flagged"))
    facts = [
        "creator", "name", "symbol", "created_at", S.resolve_pair(F.col("quote_mint")).alias("pair"), S.quote_decimals(F.col("quote_mint")).alias("decimals"),
        F.coalesce("curve_complete", F.lit(False)).alias("graduated"), "graduated_at", "pool", (F.col("graduated_at") - F.col("created_at")).alias("time_to_graduation"),
        (F.coalesce("is_mayhem", F.lit(False)) | (F.coalesce("_flagged", F.lit(0)) > 0)).alias("mayhem_enabled"), F.coalesce("_flagged", F.lit(0)).alias("_flagged"),
    ]
    # one pass over the rows of launches: a join on the mint would multiply launches that are listed twice
    out = T.lifecycle(launches.join(flagged, "mint", "left"), trades, as_of, facts)
    return out.withColumn("mayhem_activity", T.mayhem_activity(F.col("mayhem_enabled"), F.col("_flagged"), F.col("trades"))).drop("_flagged")


# --- origin and graduation ----------------------------------------------------------------------


def origin_gate(mints: DataFrame, curves: DataFrame, program_activity: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """accepted / rejected / unknown per mint.

    ``curves`` (mint, owned_by_program, decodes); ``program_activity`` (mint,
    touched) from the newest transactions; ``unreadable`` (mint) marks mints whose
    sources could not be read: absence is then no verdict.
    """
    curve = curves.filter("owned_by_program and decodes").select("mint", F.lit(True).alias("_curve")).distinct()
    touched = program_activity.filter("touched").select("mint", F.lit(True).alias("_touched")).distinct()
    out = mints.select("mint").join(curve, "mint", "left").join(touched, "mint", "left")
    lost = unreadable.select("mint", F.lit(True).alias("_lost")).distinct() if unreadable is not None else None
    out = out.join(lost, "mint", "left") if lost is not None else out.withColumn("_lost", F.lit(None).cast("boolean"))
    status = (
        F.when(F.col("_curve"), "accepted").when(F.col("_touched"), "accepted").when(F.col("_lost"), "unknown").otherwise("rejected")
    )
    reason = F.when(F.col("_curve"), "bonding curve").when(F.col("_touched"), "program activity").when(F.col("_lost"), "sources unreadable").otherwise(
        "no bonding curve and no program activity"
    )
    return out.select("mint", status.alias("status"), reason.alias("reason"))


def origin_rejects(gate: DataFrame) -> DataFrame:
    return gate.filter("status = 'rejected'").select("mint", "reason")


def creation_lookup(mint_tx: DataFrame, creates: DataFrame) -> DataFrame:
    """Oldest transaction of each mint and what its create event says.

    ``mint_tx`` (mint, kind metadata|curve, signature, slot, block_time, touched);
    the metadata address wins over the curve.  Without an event the time counts
    only if the launch program was touched.
    """
    first = F.min(F.struct(F.when(F.col("kind") == "metadata", 0).otherwise(1).alias("k"), "block_time", "slot", "signature", "touched"))
    oldest = mint_tx.groupBy("mint").agg(first.alias("_f")).select("mint", "_f.*")
    event = creates.select("mint", "signature", F.coalesce("creator", "user").alias("creator"), F.col("timestamp").alias("_t"), F.lit(True).alias("_e"))
    out = oldest.join(event, ["mint", "signature"], "left")
    known = F.coalesce("_e", F.lit(False))
    return out.filter(known | F.col("touched")).select(
        "mint", F.col("signature").alias("create_signature"), F.coalesce(S.known(F.col("_t")), F.col("block_time")).alias("created_at"), "creator"
    )


def locate_pool(pool_events: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool of each mint: the one its newest pool event names, if the pool's account agrees."""
    newest = F.max(F.struct("block_time", "slot", "signature", "pool", F.when(F.col("name") == "CreatePoolEvent", F.col("timestamp")).alias("created")))
    named = pool_events.filter("pool is not null").groupBy("mint").agg(newest.alias("_n")).select("mint", "_n.pool", F.col("_n.created").alias("pool_created_at"))
    return named.join(pools.select("pool", F.col("base_mint").alias("mint")), ["pool", "mint"], "left_semi")


def graduation_info(launches: DataFrame, completes: DataFrame, migrations: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Graduation facts: a migration wins, a completion fills in, the pool's creation is the last resort."""
    done = completes.groupBy("mint").agg(F.min(F.struct("timestamp", "signature")).alias("_c"))
    moved = migrations.groupBy("mint").agg(F.max(F.struct("timestamp", "signature", "pool")).alias("_m"))
    out = launches.select("mint", "created_at", F.coalesce("curve_complete", F.lit(False)).alias("_flag")).join(done, "mint", "left").join(moved, "mint", "left")
    found = pools.select("mint", F.col("pool").alias("_pool"), F.col("pool_created_at").alias("_made")) if pools is not None else None
    if found is not None:
        out = out.join(found, "mint", "left")
    else:
        out = out.withColumn("_pool", F.lit(None).cast("string")).withColumn("_made", F.lit(None).cast("long"))
    at = F.coalesce(S.known(F.col("_m.timestamp")), F.when(F.col("_flag"), F.col("_made")), F.col("_c.timestamp"))
    return out.select(
        "mint",
        (F.col("_flag") | F.col("_m").isNotNull() | F.col("_c").isNotNull()).alias("graduated"),
        at.alias("graduation_time"),
        F.coalesce("_m.signature", "_c.signature").alias("graduation_signature"),
        F.coalesce("_m.pool", "_pool").alias("pool"),
        (at - F.col("created_at")).alias("time_to_graduation"),
    )


def metadata_by_priority(primary: DataFrame, secondary: DataFrame, creates: DataFrame) -> DataFrame:
    """Token metadata: the first provider that knows the mint, then what the create event states.

    The event decides name, symbol and creator and only fills uri and time.
    """
    cols = ["name", "symbol", "uri", "image", "decimals"]
    a = primary.select("mint", F.struct(*cols).alias("_a"))
    b = secondary.select("mint", F.struct(*cols).alias("_b"))
    e = creates.select("mint", F.struct("name", "symbol", "uri", F.coalesce("creator", "user").alias("creator"), "timestamp", "signature").alias("_e"))
    out = a.join(b, "mint", "full").join(e, "mint", "full").withColumn("_p", F.coalesce("_a", "_b"))
    return out.select(
        "mint",
        F.coalesce("_e.name", "_p.name").alias("name"),
        F.coalesce("_e.symbol", "_p.symbol").alias("symbol"),
        F.coalesce("_p.uri", "_e.uri").alias("uri"),
        F.col("_p.image").alias("image"),
        F.col("_p.decimals").alias("decimals"),
        F.col("_e.creator").alias("creator"),
        F.col("_e.timestamp").alias("created_at"),
        F.when(F.col("_a").isNotNull(), "complete").when(F.col("_b").isNotNull(), "partial").otherwise("missing").alias("coverage"),
    )
