"""Decode jobs over raw documents that Spark builds from the test tables, and the remaining point queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mintweave.catalog.flows import scan
from mintweave.catalog.registry import query
from mintweave.catalog.scoring import REPORT, VERDICT_SQL, coherent_rows
from mintweave.functions import scalars as S
from mintweave.operators import clusters as K
from mintweave.operators import scoring as R
from mintweave.plans import summaries as U
from mintweave.sources import bindings as B
from mintweave.sources import decode as X


def little_endian(x: Column, size: int = 8) -> Column:
    """Bytes of a non-negative integer, lowest first."""
    digits = F.lpad(F.hex(x.cast("long")), size * 2, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def address_bytes(x: Column) -> Column:
    return F.unhex(F.sha2(x.cast("string"), 256))


def tag(kind: str, name: str) -> Column:
    return F.unhex(F.lit(X.discriminator(kind, name).hex()))


def complete_payload(key: Column, at: Column) -> Column:
    who = address_bytes(key)
    return F.concat(tag("event", "CompleteEvent"), who, who, who, little_endian(at), who)


NAMES = list(X.INSTRUCTIONS)


def raw_transactions(spark, sf):
    """One nested document per order: its customer pays the fee, every line is an account and an instruction."""
    c = F.col
    lines = B.table(spark, sf, "lineitem").withColumn("code", (c("l_orderkey") + c("l_linenumber")) % len(NAMES))
    data = F.element_at(F.array(*[F.lit(X.b58encode(X.discriminator("global", n) + b"data")) for n in NAMES]), c("code").cast("int") + 1)
    account = F.concat(F.lit("S"), c("l_suppkey").cast("string"))
    item = F.struct("l_linenumber", "l_partkey", account.alias("a"), F.floor("l_extendedprice").cast("long").alias("p"), c("l_quantity").cast("long").alias("q"), data.alias("d"))
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    rows = B.table(spark, sf, "orders").join(per, c("o_orderkey") == c("l_orderkey"), "left")
    items = F.coalesce("i", F.expr("cast(array() as array<struct<l_linenumber:int,l_partkey:bigint,a:string,p:bigint,q:bigint,d:string>>)"))
    at = B.day_epoch(c("o_orderdate"))
    payer = F.concat(F.lit("C"), c("o_custkey").cast("string"))
    keys = F.concat(F.array(payer), F.transform(items, lambda x: x["a"]), F.array(F.lit(X.LAUNCH_PROGRAM)))
    index = F.size(keys) - 1

    def balances(sign: int) -> Column:
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        paid = F.transform(items, lambda x: x["p"] if sign < 0 else zero)
        return F.concat(F.array(one), paid, F.array(one)) if sign < 0 else F.concat(F.array(F.aggregate(items, one, lambda acc, x: acc + x["p"])), paid, F.array(one))

    def tokens(sign: int) -> Column:
        kept = F.filter(items, lambda x: (x["l_linenumber"] % 2 == 0) if sign < 0 else (x["l_linenumber"] % 2 == 1))
        return F.transform(kept, lambda x: F.struct(x["a"].alias("owner"), F.concat(F.lit("M"), (x["l_partkey"] % 3).cast("string")).alias("mint"), F.struct(x["q"].cast("string").alias("amount")).alias("uiTokenAmount")))

    log = F.concat(F.lit(X.LOG_PREFIX), F.base64(complete_payload(c("o_orderkey"), at)))
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        F.floor(at / 86400).cast("long").alias("slot"), at.alias("blockTime"),
        F.struct(
            F.array(c("o_orderkey").cast("string")).alias("signatures"),
            F.struct(
                keys.alias("accountKeys"),
                F.transform(items, lambda x: F.struct(index.alias("programIdIndex"), F.lit(None).cast("string").alias("programId"), x["d"].alias("data"))).alias("instructions"),
            ).alias("message"),
        ).alias("transaction"),
        F.struct(
            F.when(c("o_orderstatus") == "P", "failed").alias("err"), F.lit(0).cast("long").alias("fee"), balances(-1).alias("preBalances"), balances(1).alias("postBalances"),
            tokens(-1).alias("preTokenBalances"), tokens(1).alias("postTokenBalances"), F.struct(none.alias("writable"), none.alias("readonly")).alias("loadedAddresses"),
            F.expr("cast(array() as array<struct<index:int,instructions:array<struct<programIdIndex:int,programId:string,data:string>>>>)").alias("innerInstructions"),
            F.array(log, F.lit("Program data: ???"), F.concat(F.lit("Program "), F.lit(X.POOL_PROGRAM), F.lit(" invoke [1]"))).alias("logMessages"),
        ).alias("meta"),
    )


@query("decode_transactions", sql=f"""
SELECT o_orderkey::VARCHAR AS signature, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS slot, 'C' || o_custkey AS fee_payer, o_orderstatus <> 'P' AS success, (count(l_orderkey) + 2)::INT AS accounts,
 CASE WHEN count(l_orderkey) > 0 THEN '{X.LAUNCH_PROGRAM},{X.POOL_PROGRAM}' ELSE '{X.POOL_PROGRAM}' END AS programs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_custkey, o_orderstatus""")
def _(spark, sf):
    tx = X.decode_transactions(raw_transactions(spark, sf))
    return tx.select("signature", "slot", "fee_payer", "success", F.size("account_keys").alias("accounts"), F.array_join(F.array_sort("programs"), ",").alias("programs"))


@query("sol_balance_deltas", sql="""
WITH d AS (SELECT l_orderkey, 'S' || l_suppkey AS address, -floor(l_extendedprice)::BIGINT AS delta FROM lineitem UNION ALL SELECT l_orderkey, 'C' || o_custkey, floor(l_extendedprice)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey::VARCHAR AS signature, address, sum(delta)::BIGINT AS delta FROM d GROUP BY ALL HAVING sum(delta) <> 0""")
def _(spark, sf):
    return X.sol_balance_deltas(X.decode_transactions(raw_transactions(spark, sf))).select("signature", "address", "delta")


@query("token_balance_deltas", sql="""
SELECT l_orderkey::VARCHAR AS signature, 'S' || l_suppkey AS owner, 'M' || (l_partkey % 3) AS mint, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE -l_quantity END)::BIGINT AS delta FROM lineitem GROUP BY ALL HAVING sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE -l_quantity END) <> 0""")
def _(spark, sf):
    return X.token_balance_deltas(X.decode_transactions(raw_transactions(spark, sf))).select("signature", "owner", "mint", "delta")


@query("decode_events_from_logs", sql="SELECT o_orderkey::VARCHAR AS signature, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 AS timestamp, TRUE AS same_keys FROM orders")
def _(spark, sf):
    events = X.event_payloads(X.decode_transactions(raw_transactions(spark, sf)))
    return X.decode_events(events, "CompleteEvent").select("signature", "timestamp", ((F.col("mint") == F.col("user")) & (F.length("mint") >= 32)).alias("same_keys"))


@query("decode_instruction_names", sql=f"SELECT l_orderkey::VARCHAR AS signature, [{', '.join(repr(n) for n in NAMES)}][((l_orderkey + l_linenumber) % {len(NAMES)} + 1)::INT] AS instruction, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    names = X.decode_instruction_names(X.decode_transactions(raw_transactions(spark, sf)))
    return names.groupBy("signature", "instruction").agg(F.count(F.lit(1)).alias("n"))


@query("decode_events", sql="SELECT l_orderkey::VARCHAR AS signature, l_linenumber::BIGINT AS slot, l_quantity::BIGINT AS timestamp, l_partkey::VARCHAR AS fee_payer FROM lineitem")
def _(spark, sf):
    c = F.col
    who = address_bytes(c("l_partkey"))
    body = F.concat(F.unhex(F.lit(X.EVENT_TAG.hex())), tag("event", "SetCreatorEvent"), little_endian(c("l_quantity")), who, who, who)
    payloads = B.table(spark, sf, "lineitem").select(
        c("l_orderkey").cast("string").alias("signature"), c("l_linenumber").cast("long").alias("slot"), F.lit(0).cast("long").alias("block_time"), F.lit(True).alias("success"),
        c("l_partkey").cast("string").alias("fee_payer"), body.alias("payload"))
    return X.decode_events(payloads, "SetCreatorEvent").select("signature", "slot", "timestamp", "fee_payer")


@query("decode_accounts", sql="SELECT p_partkey::VARCHAR AS address, p_size::BIGINT AS real_token_reserves, p_partkey AS token_total_supply, p_size >= 40 AS complete, p_size % 2 = 0 AS is_mayhem_mode FROM part")
def _(spark, sf):
    c = F.col
    flag = lambda x: F.unhex(F.when(x, "01").otherwise("00"))
    who = address_bytes(c("p_partkey"))
    raw = F.concat(tag("account", "BondingCurve"), *[little_endian(x) for x in (c("p_size"), c("p_size"), c("p_size"), c("p_size"), c("p_partkey"))], flag(c("p_size") >= 40), who, flag(c("p_size") % 2 == 0), flag(F.lit(False)), who)
    accounts = B.table(spark, sf, "part").select(c("p_partkey").cast("string").alias("address"), F.lit(X.LAUNCH_PROGRAM).alias("owner"), F.lit(1).cast("long").alias("lamports"), F.array(F.base64(raw), F.lit("base64")).alias("data"))
    out = X.decode_accounts(accounts, "BondingCurve")
    return out.select("address", c("real_token_reserves").cast("long").alias("real_token_reserves"), c("token_total_supply").cast("long").alias("token_total_supply"), "complete", "is_mayhem_mode")


@query("trades_from_events", "tape_l", sql="""
SELECT mint, wallet, signature, leg, block_time, is_buy, round(CASE WHEN leg % 3 = 0 THEN quote_amount / 1e6::DOUBLE WHEN leg % 3 = 1 THEN floor(quote_amount) / 1e9::DOUBLE ELSE floor(token_amount) / 1e6::DOUBLE END, 12) AS quote_amount, 'bonding_curve' AS venue
FROM (SELECT * REPLACE (floor(quote_amount) AS quote_amount) FROM tape WHERE tx_success AND leg % 2 = 1)
UNION ALL SELECT mint, wallet, signature, leg, block_time, is_buy, round(floor(quote_amount) / 1e9::DOUBLE, 12), 'pumpswap' FROM tape WHERE tx_success AND leg % 2 = 0""")
def _(spark, sf):
    c = F.col
    tape = B.tape_l(spark, sf).withColumn("success", c("tx_success")).withColumn("timestamp", c("block_time"))
    usdc, native = F.lit(S.USDC), F.lit(None).cast("string")
    explicit = F.when(c("leg") % 3 == 0, F.floor("quote_amount")).when(c("leg") % 3 == 2, F.floor("token_amount")).otherwise(F.lit(0))
    # The leg travels in the slot column: events have no leg of their own.
    trade = tape.filter("leg % 2 = 1").withColumn("user", c("wallet")).withColumn("sol_amount", F.floor("quote_amount")).withColumn("quote_amount", explicit).withColumn(
        "quote_mint", F.when(c("leg") % 3 == 1, native).otherwise(usdc)).withColumn("mayhem_mode", c("mayhem")).withColumn("slot", c("leg"))
    pooled = tape.filter("leg % 2 = 0").withColumn("user", c("wallet")).withColumn("pool", c("mint")).withColumn("slot", c("leg")).drop("mint")
    buys = pooled.withColumn("quote_amount_in", F.floor("quote_amount")).withColumn("base_amount_out", F.floor("token_amount")).filter("is_buy")
    sells = pooled.withColumn("quote_amount_out", F.floor("quote_amount")).withColumn("base_amount_in", F.floor("token_amount")).filter("not is_buy")
    pools = tape.select(c("mint").alias("pool"), c("mint").alias("base_mint")).distinct()
    curve, amm = X.trades_from_events(trade, buys, sells, pools)
    both = curve.unionByName(amm)
    return both.select("mint", "wallet", "signature", c("slot").alias("leg"), "block_time", "is_buy", F.round("quote_amount", 12).alias("quote_amount"), "venue")


@query("metadata_by_priority", "launches", sql="""
WITH e AS (SELECT * FROM launches WHERE mint % 3 <> 0)
SELECT l.mint, CASE WHEN e.mint IS NOT NULL THEN e.name WHEN l.mint % 2 = 0 THEN 'A' || l.mint WHEN l.mint % 5 <> 0 THEN 'B' || l.mint END AS name,
 CASE WHEN l.mint % 2 = 0 THEN 'uriA' WHEN l.mint % 5 <> 0 THEN 'uriB' ELSE 'uriE' END AS uri, e.creator, CASE WHEN l.mint % 2 = 0 THEN 'complete' WHEN l.mint % 5 <> 0 THEN 'partial' ELSE 'missing' END AS coverage
FROM launches l LEFT JOIN e ON e.mint = l.mint WHERE l.mint % 2 = 0 OR l.mint % 5 <> 0 OR e.mint IS NOT NULL""")
def _(spark, sf):
    c = F.col
    made = B.launches(spark, sf)

    def source(rows, letter):
        return rows.select("mint", F.concat(F.lit(letter), c("mint").cast("string")).alias("name"), F.lit("s").alias("symbol"), F.lit("uri" + letter).alias("uri"), F.lit("i").alias("image"), F.lit(6).alias("decimals"))

    creates = made.filter("mint % 3 <> 0").select("mint", "name", "symbol", F.lit("uriE").alias("uri"), "creator", c("creator").alias("user"), c("created_at").alias("timestamp"), c("create_signature").alias("signature"))
    return U.metadata_by_priority(source(made.filter("mint % 2 = 0"), "A"), source(made.filter("mint % 5 <> 0"), "B"), creates).select("mint", "name", "uri", "creator", "coverage")


@query("creation_lookup", "tape_l", "launches", sql="""
WITH t AS (SELECT mint, signature, block_time, slot, is_buy, row_number() OVER (PARTITION BY mint ORDER BY CASE WHEN leg % 2 = 0 THEN 0 ELSE 1 END, block_time, slot, signature, is_buy) AS r FROM tape)
SELECT t.mint, t.signature AS create_signature, t.block_time AS created_at, CASE WHEN l.mint IS NOT NULL THEN l.creator END AS creator FROM t LEFT JOIN launches l ON l.mint = t.mint AND l.create_signature = t.signature WHERE r = 1 AND (l.mint IS NOT NULL OR is_buy)""")
def _(spark, sf):
    made = B.launches(spark, sf)
    tx = B.tape_l(spark, sf).select("mint", F.when(F.col("leg") % 2 == 0, "metadata").otherwise("curve").alias("kind"), "signature", "slot", "block_time", F.col("is_buy").alias("touched"))
    creates = made.select("mint", F.col("create_signature").alias("signature"), "creator", F.col("creator").alias("user"), F.lit(0).cast("long").alias("timestamp"))
    return U.creation_lookup(tx, creates)


@query("locate_pool", "tape_l", "launches", sql="""
WITH n AS (SELECT mint, arg_max(wallet, (block_time, slot, signature, wallet)) AS pool FROM tape GROUP BY ALL) SELECT mint, pool FROM n WHERE pool % 2 = mint % 2""")
def _(spark, sf):
    tape = B.tape_l(spark, sf)
    events = tape.select("mint", F.lit("BuyEvent").alias("name"), F.col("wallet").alias("pool"), "block_time", "slot", "signature", F.col("block_time").alias("timestamp"))
    pools = tape.filter("wallet % 2 = mint % 2").select(F.col("wallet").alias("pool"), F.col("mint").alias("base_mint")).distinct()
    return U.locate_pool(events, pools).select("mint", "pool")


@query("pair_label", "launches", sql="SELECT mint, CASE WHEN quote_mint IS NULL OR quote_mint LIKE 'So1%' THEN 'SOL' WHEN quote_mint LIKE 'EPj%' THEN 'USDC' ELSE 'UNKNOWN' END AS pair_label FROM launches")
def _(spark, sf):
    return B.launches(spark, sf).select("mint", S.resolve_pair(F.col("quote_mint")).alias("pair_label"))


@query("verdict_text", sql=f"WITH {REPORT} SELECT mint, cluster_id, {VERDICT_SQL} AS verdict FROM risk")
def _(spark, sf):
    return R.risk_report(coherent_rows(spark, sf)).select("mint", "cluster_id", "verdict")


@query("scan_warnings")
def _(spark, sf):
    return scan(spark, sf).report.select("mint", F.array_join("warnings", "; ").alias("warnings"))


@query("cluster_signals")
def _(spark, sf):
    return scan(spark, sf).signals.select("mint", "cluster_id", "size", *[F.round(s, 6).alias(s) for s in K.SIGNALS])


@query("wallet_profiles")
def _(spark, sf):
    out = scan(spark, sf).profiles
    return out.select(
        "mint", "wallet", "position", "entity_type", "direct_funder", "funding_amount", "funding_to_buy_seconds", "age_seconds", "fresh_bucket", "first_action", "launches",
        "sold_fraction", "exit_kind", "balance_after_purchase", "risk_score", F.array_join("risk_reasons", "; ").alias("risk_reasons"), "cluster_id",
    )
