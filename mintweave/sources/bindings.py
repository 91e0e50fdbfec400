"""Canonical tables read off the star-schema test data.

Each binding has two faces: a DataFrame (``tape_l`` ...) and the same rows as a
SQL common table expression (``SQL["tape_l"]``) for the side-by-side check.
Transactions are orders, launches are parts, wallets are suppliers or
customers, and the time unit of the data is one day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave import params as P

DAY = 86400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, whatever the session's time zone."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (F.unix_date(ts.cast("date")).cast("long") * 86400 + seconds).cast("long")


def day_epoch(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("long") * F.lit(DAY).cast("long")


def _slot(ts: Column) -> Column:
    return (F.unix_date(ts.cast("date")) - F.lit(9131)).cast("long")  # days since 1995-01-01


def _tape(spark: SparkSession, sf: str, mint: Column, wallet: Column, parts: bool = False) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        brand = table(spark, sf, "part").select("p_partkey", "p_brand")
        rows = rows.join(brand, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        mint.alias("mint"),
        wallet.alias("wallet"),
        F.col("l_orderkey").alias("signature"),
        F.col("o_custkey").alias("fee_payer"),
        day_epoch(F.col("l_shipdate")).alias("block_time"),
        _slot(F.col("l_shipdate")).alias("slot"),
        F.col("l_linenumber").alias("leg"),
        (F.col("l_returnflag") != "R").alias("is_buy"),
        F.col("l_extendedprice").alias("quote_amount"),
        F.col("l_quantity").alias("token_amount"),
        (F.col("l_returnflag") == "A").alias("mayhem"),
        (F.col("o_orderstatus") != "P").alias("tx_success"),
        F.floor(F.lit(float(P.INITIAL_REAL_TOKENS)) * (0.999 - F.col("l_discount") * 0.97))
        .cast("long")
        .alias("real_token_reserves"),
        F.col("l_partkey").alias("part"),
    )


_TAPE_SQL = """{name} AS (
 SELECT {mint} AS mint, {wallet} AS wallet, l_orderkey AS signature, o_custkey AS fee_payer,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 86400 AS block_time,
  date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS slot,
  l_linenumber AS leg, l_returnflag <> 'R' AS is_buy, l_extendedprice AS quote_amount, l_quantity AS token_amount,
  l_returnflag = 'A' AS mayhem, o_orderstatus <> 'P' AS tx_success,
  floor(793100000000000.0::DOUBLE * (0.999::DOUBLE - l_discount * 0.97::DOUBLE))::BIGINT AS real_token_reserves,
  l_partkey AS part
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey {extra})"""

ORDER_SQL = "block_time, slot, signature, leg, wallet, token_amount, quote_amount"


def tape_l(spark: SparkSession, sf: str) -> DataFrame:
    """Launch = part, wallet = supplier."""
    return _tape(spark, sf, F.col("l_partkey"), F.col("l_suppkey"))


def tape_b(spark: SparkSession, sf: str) -> DataFrame:
    """Launch = brand: 25 hot launches that share every wallet."""
    return _tape(spark, sf, F.col("p_brand"), F.col("l_suppkey"), parts=True)


def tape_c(spark: SparkSession, sf: str) -> DataFrame:
    """Launch = part, wallet = customer; meets ``transfers``."""
    customer = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return _tape(spark, sf, F.col("l_partkey"), customer).withColumn("fee_payer", F.col("wallet"))


def tape_s(spark: SparkSession, sf: str) -> DataFrame:
    """Launch = part, wallet = supplier address; the fee payer is the customer address."""
    return _tape(spark, sf, F.col("l_partkey"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).withColumn(
        "fee_payer", F.concat(F.lit("C"), F.col("fee_payer").cast("string"))
    )


def launches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per part; created with its first trade by the supplier of that trade."""
    first = F.min_by(F.struct("l_suppkey"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"))
    made = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        first["l_suppkey"].alias("_by"), F.min("l_shipdate").alias("_at"), F.min("l_orderkey").alias("_sig")
    )
    size = F.col("p_size")
    created = day_epoch(F.col("_at"))
    return made.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("mint"),
        F.concat(F.lit("S"), F.col("_by").cast("string")).alias("creator"),
        created.alias("created_at"),
        F.col("_sig").alias("create_signature"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("symbol"),
        (size % 10 == 0).alias("is_mayhem"),
        (size >= 40).alias("curve_complete"),
        F.floor(F.lit(float(P.INITIAL_REAL_TOKENS)) * (50 - size) / 50.0).cast("long").alias("real_token_reserves"),
        F.lit(P.INITIAL_REAL_TOKENS).cast("long").alias("initial_real_tokens"),
        F.when(size % 3 == 0, F.lit("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"))
        .when(size % 3 == 1, F.lit("So11111111111111111111111111111111111111112"))
        .when(size % 7 == 0, F.lit("other"))
        .alias("quote_mint"),
        F.when((size >= 40) & (size % 2 == 0), F.concat(F.lit("pool"), F.col("p_partkey").cast("string"))).alias("pool"),
        F.when(size >= 40, created + size * DAY).alias("graduated_at"),
    )


_LAUNCHES_SQL = """launches AS (
 SELECT p_partkey AS mint, 'S' || _by AS creator, created_at, _sig AS create_signature, p_name AS name, p_brand AS symbol,
  p_size % 10 = 0 AS is_mayhem, p_size >= 40 AS curve_complete,
  floor(793100000000000.0::DOUBLE * (50 - p_size) / 50.0::DOUBLE)::BIGINT AS real_token_reserves,
  793100000000000::BIGINT AS initial_real_tokens,
  CASE WHEN p_size % 3 = 0 THEN 'EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v'
       WHEN p_size % 3 = 1 THEN 'So11111111111111111111111111111111111111112'
       WHEN p_size % 7 = 0 THEN 'other' END AS quote_mint,
  CASE WHEN p_size >= 40 AND p_size % 2 = 0 THEN 'pool' || p_partkey END AS pool,
  CASE WHEN p_size >= 40 THEN created_at + p_size * 86400 END AS graduated_at
 FROM (SELECT l_partkey, date_diff('day', DATE '1970-01-01', min(l_shipdate)::DATE) * 86400 AS created_at, min(l_orderkey) AS _sig,
   arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)) AS _by
  FROM lineitem GROUP BY l_partkey) JOIN part ON l_partkey = p_partkey)"""


def transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Layered payments: part -> supplier when shipped, supplier -> customer when ordered."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    up = lines.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"),
        supplier.alias("recipient"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_orderkey").alias("signature"),
        day_epoch(F.col("l_shipdate")).alias("block_time"),
        F.lit(0.0).alias("recipient_before"),
        (F.col("l_extendedprice") + F.col("l_quantity")).alias("recipient_after"),
    )
    down = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        supplier.alias("source"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("recipient"),
        F.col("o_totalprice").alias("amount"),
        F.col("l_orderkey").alias("signature"),
        day_epoch(F.col("o_orderdate")).alias("block_time"),
        F.lit(0.0).alias("recipient_before"),
        (F.col("o_totalprice") + 1.0).alias("recipient_after"),
    )
    return up.unionByName(down).withColumn("slot", F.floor(F.col("block_time") / DAY).cast("long")).withColumn("asset", F.lit("SOL"))


_TRANSFERS_SQL = """transfers AS (
 SELECT *, block_time // 86400 AS slot, 'SOL' AS asset FROM (
  SELECT 'P' || l_partkey AS source, 'S' || l_suppkey AS recipient, l_extendedprice AS amount, l_orderkey AS signature,
   date_diff('day', DATE '1970-01-01', l_shipdate::DATE) * 86400 AS block_time, 0.0::DOUBLE AS recipient_before,
   l_extendedprice + l_quantity AS recipient_after FROM lineitem
  UNION ALL
  SELECT 'S' || l_suppkey, 'C' || o_custkey, o_totalprice, l_orderkey,
   date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400, 0.0::DOUBLE, o_totalprice + 1.0::DOUBLE
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""


def sol_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Balance changes per order: the customer receives, every supplier on it pays."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(F.floor(F.col("l_extendedprice") * 1000000).cast("long")).alias("paid")
    )
    orders = table(spark, sf, "orders")
    head = orders.select(
        F.col("o_orderkey").alias("signature"),
        day_epoch(F.col("o_orderdate")).alias("block_time"),
        (F.col("o_orderstatus") != "P").alias("success"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("fee_payer"),
        F.floor(F.col("o_totalprice") * 1000000).cast("long").alias("total"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    inflow = head.select(
        "signature", "block_time", "success", "fee_payer",
        F.col("fee_payer").alias("address"),
        F.lit(1000).cast("long").alias("pre"),
        F.when(F.col("urgent"), F.lit(1500).cast("long")).otherwise(F.col("total") + 1000).alias("post"),
    )
    outflow = head.join(lines, F.col("signature") == F.col("l_orderkey")).select(
        "signature", "block_time", "success", "fee_payer",
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("address"),
        F.col("paid").alias("pre"),
        F.lit(0).cast("long").alias("post"),
    )
    return (
        inflow.unionByName(outflow)
        .withColumn("delta", F.col("post") - F.col("pre"))
        .withColumn("slot", F.floor(F.col("block_time") / DAY).cast("long"))
    )


def token_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Stable-coin movements of the urgent orders."""
    usdc = F.lit("EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v")
    orders = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    head = orders.select(
        F.col("o_orderkey").alias("signature"),
        day_epoch(F.col("o_orderdate")).alias("block_time"),
        (F.col("o_orderstatus") != "P").alias("success"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("_c"),
        F.floor(F.col("o_totalprice") * 1000).cast("long").alias("_total"),
    )
    plus = head.select("signature", "block_time", "success", F.col("_c").alias("owner"), F.col("_total").alias("delta"))
    paid = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(F.floor(F.col("l_extendedprice") * 1000).cast("long")).alias("_paid")
    )
    minus = head.join(paid, F.col("signature") == F.col("l_orderkey")).select(
        "signature", "block_time", "success",
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("owner"),
        (-F.col("_paid")).alias("delta"),
    )
    return (
        plus.unionByName(minus).withColumn("mint", usdc).withColumn("slot", F.floor(F.col("block_time") / DAY).cast("long"))
    )


_SOL_DELTAS_SQL = """sol_deltas AS (
 SELECT *, post - pre AS delta, block_time // 86400 AS slot FROM (
  SELECT o_orderkey AS signature, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 AS block_time,
   o_orderstatus <> 'P' AS success, 'C' || o_custkey AS fee_payer, 'C' || o_custkey AS address, 1000::BIGINT AS pre,
   CASE WHEN o_orderpriority = '1-URGENT' THEN 1500 ELSE floor(o_totalprice * 1000000)::BIGINT + 1000 END AS post FROM orders
  UNION ALL
  SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400, o_orderstatus <> 'P',
   'C' || o_custkey, 'S' || l_suppkey, sum(floor(l_extendedprice * 1000000)::BIGINT)::BIGINT, 0::BIGINT
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)),
token_deltas AS (
 SELECT *, 'EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v' AS mint, block_time // 86400 AS slot FROM (
  SELECT o_orderkey AS signature, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 AS block_time,
   o_orderstatus <> 'P' AS success, 'C' || o_custkey AS owner, floor(o_totalprice * 1000)::BIGINT AS delta
  FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400, o_orderstatus <> 'P',
   'S' || l_suppkey, -sum(floor(l_extendedprice * 1000)::BIGINT)::BIGINT
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL))"""


def wallet_tx(spark: SparkSession, sf: str) -> DataFrame:
    """Every order touches its customer's address; failed ones carry an error."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("address"),
        F.col("o_orderkey").alias("signature"),
        day_epoch(F.col("o_orderdate")).alias("block_time"),
        F.floor(day_epoch(F.col("o_orderdate")) / DAY).cast("long").alias("slot"),
        F.when(F.col("o_orderstatus") == "P", "failed").alias("err"),
    )


_WALLET_TX_SQL = """wallet_tx AS (
 SELECT 'C' || o_custkey AS address, o_orderkey AS signature,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 AS block_time,
  date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS slot,
  CASE WHEN o_orderstatus = 'P' THEN 'failed' END AS err FROM orders)"""


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier addresses labelled by nation."""
    nation = table(spark, sf, "nation")
    key = F.col("s_nationkey")
    return table(spark, sf, "supplier").join(nation, key == F.col("n_nationkey")).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("address"),
        F.col("n_name").alias("label"),
        F.when(key < 3, "CEX").when(key == 3, "BRIDGE").when(key == 4, "PROGRAM").alias("entity_type"),
        F.lit("registry").alias("source"),
        F.lit(0.8).alias("confidence"),
        (key < 3).alias("verify"),
    ).filter("entity_type is not null")


def provider_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A second, free-text label layer: part names for part addresses."""
    return table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("address"), _label_text().alias("label")
    )


def _label_text() -> Column:
    size = F.col("p_size")
    tail = (
        F.when(size == 1, " Exchange").when(size == 2, " bridge").when(size == 3, " PumpSwap").when(size == 4, " pump.fun fees")
        .when(size == 5, " Authority").when(size == 6, " Treasury").when(size == 7, " Incinerator").when(size == 8, " Raydium")
        .otherwise("")
    )
    return F.concat(F.col("p_name"), tail)


_ENTITIES_SQL = """entities AS (
 SELECT * FROM (SELECT 'S' || s_suppkey AS address, n_name AS label,
  CASE WHEN s_nationkey < 3 THEN 'CEX' WHEN s_nationkey = 3 THEN 'BRIDGE' WHEN s_nationkey = 4 THEN 'PROGRAM' END AS entity_type,
  'registry' AS source, 0.8::DOUBLE AS confidence, s_nationkey < 3 AS verify
 FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE entity_type IS NOT NULL),
provider_labels AS (
 SELECT 'P' || p_partkey AS address, p_name || CASE p_size WHEN 1 THEN ' Exchange' WHEN 2 THEN ' bridge' WHEN 3 THEN ' PumpSwap'
  WHEN 4 THEN ' pump.fun fees' WHEN 5 THEN ' Authority' WHEN 6 THEN ' Treasury' WHEN 7 THEN ' Incinerator' WHEN 8 THEN ' Raydium'
  ELSE '' END AS label FROM part)"""


def holders(spark: SparkSession, sf: str) -> DataFrame:
    """Positions per (part, supplier); the provider tells which source listed the row."""
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("amount")
    ).select(
        F.col("l_partkey").alias("mint"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("owner"),
        "amount",
        F.element_at(F.array(F.lit("helius"), F.lit("solscan"), F.lit("rpc")), ((F.col("l_suppkey") + F.col("l_partkey")) % 3 + 1).cast("int")).alias("provider"),
    )


_HOLDERS_SQL = """holders AS (
 SELECT l_partkey AS mint, 'S' || l_suppkey AS owner,
  sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE -l_quantity END) AS amount,
  ['helius', 'solscan', 'rpc'][((l_suppkey + l_partkey) % 3 + 1)::INT] AS provider
 FROM lineitem GROUP BY l_partkey, l_suppkey)"""


SQL = {
    "tape_l": _TAPE_SQL.format(name="tape", mint="l_partkey", wallet="l_suppkey", extra=""),
    "tape_b": _TAPE_SQL.format(name="tape", mint="p_brand", wallet="l_suppkey", extra="JOIN part ON l_partkey = p_partkey"),
    "tape_c": _TAPE_SQL.format(name="tape", mint="l_partkey", wallet="'C' || o_custkey", extra="").replace(
        "o_custkey AS fee_payer", "'C' || o_custkey AS fee_payer"
    ),
    "tape_s": _TAPE_SQL.format(name="tape", mint="l_partkey", wallet="'S' || l_suppkey", extra="").replace(
        "o_custkey AS fee_payer", "'C' || o_custkey AS fee_payer"
    ),
    "launches": _LAUNCHES_SQL,
    "transfers": _TRANSFERS_SQL,
    "deltas": _SOL_DELTAS_SQL,
    "wallet_tx": _WALLET_TX_SQL,
    "entities": _ENTITIES_SQL,
    "holders": _HOLDERS_SQL,
}
