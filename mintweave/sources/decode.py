"""Raw transactions, accounts and event payloads to typed tables.

Structure is taken apart with Spark's own array functions.  Python runs only
where bytes must be read: base58 text and binary payloads, in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S

# Program addresses and the tag in front of self-invoked events.
LAUNCH_PROGRAM = "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P"
POOL_PROGRAM = "pAMMBay6oceH9fJKBRHGP5D4bD4sWpmSwMn52FMfXEA"
EVENT_TAG = (0x1D9ACB512EA545E4).to_bytes(8, "little")
LOG_PREFIX = "Program data: "

# Field layouts, little endian, in order.
_AMM = (
    "user_base_token_reserves u64, user_quote_token_reserves u64, pool_base_token_reserves u64, pool_quote_token_reserves u64, "
    "{quote} u64, lp_fee_basis_points u64, lp_fee u64, protocol_fee_basis_points u64, protocol_fee u64, {net} u64, {user} u64, "
    "pool pubkey, user pubkey, user_base_token_account pubkey, user_quote_token_account pubkey, protocol_fee_recipient pubkey, "
    "protocol_fee_recipient_token_account pubkey, coin_creator pubkey"
)
EVENT_LAYOUTS = {
    "CreateEvent": "name string, symbol string, uri string, mint pubkey, bonding_curve pubkey, user pubkey, creator pubkey, "
    "timestamp i64, virtual_token_reserves u64, virtual_sol_reserves u64, real_token_reserves u64, token_total_supply u64, "
    "token_program pubkey, is_mayhem_mode bool, is_cashback_enabled bool, quote_mint pubkey, virtual_quote_reserves u64",
    "TradeEvent": "mint pubkey, sol_amount u64, token_amount u64, is_buy bool, user pubkey, timestamp i64, virtual_sol_reserves u64, "
    "virtual_token_reserves u64, real_sol_reserves u64, real_token_reserves u64, fee_recipient pubkey, fee_basis_points u64, fee u64, "
    "creator pubkey, creator_fee_basis_points u64, creator_fee u64, track_volume bool, total_unclaimed_tokens u64, "
    "total_claimed_tokens u64, current_sol_volume u64, last_update_timestamp i64, ix_name string, mayhem_mode bool, "
    "cashback_fee_basis_points u64, cashback u64, buyback_fee_basis_points u64, buyback_fee u64, shareholders skip34, "
    "quote_mint pubkey, quote_amount u64, virtual_quote_reserves u64, real_quote_reserves u64",
    "CompleteEvent": "user pubkey, mint pubkey, bonding_curve pubkey, timestamp i64, quote_mint pubkey",
    "CompletePumpAmmMigrationEvent": "user pubkey, mint pubkey, mint_amount u64, sol_amount u64, pool_migration_fee u64, "
    "bonding_curve pubkey, timestamp i64, pool pubkey, quote_mint pubkey",
    "SetCreatorEvent": "timestamp i64, mint pubkey, bonding_curve pubkey, creator pubkey",
    "UpdateMayhemVirtualParamsEvent": "",
    "BuyEvent": "timestamp i64, base_amount_out u64, max_quote_amount_in u64, "
    + _AMM.format(quote="quote_amount_in", net="quote_amount_in_with_lp_fee", user="user_quote_amount_in"),
    "SellEvent": "timestamp i64, base_amount_in u64, min_quote_amount_out u64, "
    + _AMM.format(quote="quote_amount_out", net="quote_amount_out_without_lp_fee", user="user_quote_amount_out"),
    "CreatePoolEvent": "timestamp i64, index u16, creator pubkey, base_mint pubkey, quote_mint pubkey, base_mint_decimals u8, "
    "quote_mint_decimals u8, base_amount_in u64, quote_amount_in u64, pool_base_amount u64, pool_quote_amount u64, "
    "minimum_liquidity u64, initial_liquidity u64, lp_token_amount_out u64, pool_bump u8, pool pubkey, lp_mint pubkey, "
    "user_base_token_account pubkey, user_quote_token_account pubkey, coin_creator pubkey, is_mayhem_mode bool",
}
ACCOUNT_LAYOUTS = {
    "BondingCurve": "virtual_token_reserves u64, virtual_quote_reserves u64, real_token_reserves u64, real_quote_reserves u64, "
    "token_total_supply u64, complete bool, creator pubkey, is_mayhem_mode bool, is_cashback_coin bool, quote_mint pubkey",
    "Pool": "pool_bump u8, index u16, creator pubkey, base_mint pubkey, quote_mint pubkey, lp_mint pubkey, "
    "pool_base_token_account pubkey, pool_quote_token_account pubkey, lp_supply u64, coin_creator pubkey, is_mayhem_mode bool, "
    "is_cashback_coin bool, virtual_quote_reserves i128",
    "Global": "initialized bool, authority pubkey, fee_recipient pubkey, initial_virtual_token_reserves u64, "
    "initial_virtual_sol_reserves u64, initial_real_token_reserves u64",
}
INSTRUCTIONS = (
    "create", "create_v2", "buy", "buy_v2", "buy_exact_sol_in", "buy_exact_quote_in_v2", "sell", "sell_v2", "migrate", "migrate_v2",
    "toggle_mayhem_mode", "set_mayhem_virtual_params",
)


def discriminator(kind: str, name: str) -> bytes:
    """First eight bytes of ``sha256("<kind>:<name>")``, the tag rule of the on-chain framework."""
    return hashlib.sha256(f"{kind}:{name}".encode()).digest()[:8]


# --- bytes -----------------------------------------------------------------------------------

_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGIT = {c: i for i, c in enumerate(_ALPHABET)}


def b58encode(data: bytes) -> str:
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = _ALPHABET[r] + out
    return "1" * (len(data) - len(data.lstrip(b"\0"))) + out


def b58decode(text: str) -> bytes | None:
    n = 0
    for c in text:
        if c not in _DIGIT:
            return None
        n = n * 58 + _DIGIT[c]
    ones = len(text) - len(text.lstrip("1"))
    return b"\0" * ones + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base58_to_binary(column: Column) -> Column:
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else b58decode(t))

    return run(column)


def base58_valid(column: Column) -> Column:
    """32 to 44 characters of the alphabet that decode to 32 bytes."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t is not None and 32 <= len(t) <= 44 and len(b58decode(t) or b"") == 32)

    return run(column)


_WIDTH = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i64": 8, "u128": 16, "i128": 16, "bool": 1, "pubkey": 32}
_SPARK = {
    "u8": "short", "u16": "int", "u32": "long", "u64": "decimal(20,0)", "i64": "long", "u128": "decimal(38,0)", "i128": "decimal(38,0)",
    "bool": "boolean", "pubkey": "string", "string": "string",
}


def _fields(layout: str) -> list[tuple[str, str]]:
    return [tuple(item.split()) for item in layout.split(", ")] if layout else []


def _take(kind: str, data: bytes, at: int) -> tuple[object, int]:
    """One value and the next offset; raises when the payload ends early."""
    if kind in ("string", "skip34"):
        size = int.from_bytes(data[at : at + 4], "little")
        start, end = at + 4, at + 4 + size * (34 if kind == "skip34" else 1)
        if at + 4 > len(data) or end > len(data):
            raise EOFError
        return (data[start:end].decode("utf-8", "replace") if kind == "string" else None), end
    end = at + _WIDTH[kind]
    if end > len(data):
        raise EOFError
    raw = data[at:end]
    if kind == "pubkey":
        return b58encode(raw), end
    n = int.from_bytes(raw, "little", signed=kind[0] == "i")
    if kind == "bool":
        return bool(n), end
    return (Decimal(n) if kind in ("u64", "u128", "i128") else n), end


def _read(data: bytes, fields: list[tuple[str, str]], at: int) -> dict[str, object]:
    """Fields in order; a short payload gives the fields that fit."""
    out: dict[str, object] = {}
    for name, kind in fields:
        try:
            value, at = _take(kind, data, at)
        except EOFError:
            break
        if kind != "skip34":
            out[name] = value
    return out


def decode_payloads(payloads: DataFrame, layout: str, tag: bytes, keep: list[str]) -> DataFrame:
    """Rows whose ``payload`` starts with ``tag``, read by ``layout``; ``keep`` columns pass through."""
    body = F.when(F.substring("payload", 1, 8) == F.lit(EVENT_TAG), F.expr("substring(payload, 9)")).otherwise(F.col("payload"))
    rows = payloads.select(*keep, body.alias("payload")).filter(F.substring("payload", 1, 8) == F.lit(tag))
    fields = _fields(layout)
    shown = [(n, k) for n, k in fields if k != "skip34"]
    if not shown:
        return rows.drop("payload")
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "payload")
    schema = passed + (", " if passed else "") + ", ".join(f"`{n}` {_SPARK[k]}" for n, k in shown)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            decoded = [_read(bytes(p), fields, 8) for p in batch["payload"]]
            out = batch.drop(columns="payload").reset_index(drop=True)
            for name, _ in shown:
                out[name] = pd.Series([d.get(name) for d in decoded], dtype=object)
            yield out

    return rows.mapInPandas(run, schema)


# --- transactions -------------------------------------------------------------------------------


def decode_transactions(raw: DataFrame) -> DataFrame:
    """One typed row per transaction.  Expects ``schemas.RAW_TX``; an ``id`` column may carry the signature."""
    c = F.col
    empty = F.expr("cast(array() as array<string>)")

    def strings(column: str) -> Column:
        return F.coalesce(c(column), empty)

    given = c("id") if "id" in raw.columns else F.lit(None).cast("string")
    keys = F.concat(strings("transaction.message.accountKeys"), strings("meta.loadedAddresses.writable"), strings("meta.loadedAddresses.readonly"))
    rows = raw.select(
        F.coalesce(given, F.get("transaction.signatures", F.lit(0))).alias("signature"),
        F.coalesce("slot", F.lit(0)).cast("long").alias("slot"),
        c("blockTime").alias("block_time"),
        c("meta.err").isNull().alias("success"),
        c("meta.err").alias("error"),
        keys.alias("account_keys"),
        "transaction",
        "meta",
    ).filter("signature is not null")
    kind = "cast(array() as array<struct<programIdIndex:int,programId:string,data:string>>)"
    outer = F.coalesce("transaction.message.instructions", F.expr(kind))
    inner = F.flatten(F.transform(F.coalesce("meta.innerInstructions", F.expr("cast(array() as array<struct<index:int,instructions:array<struct<programIdIndex:int,programId:string,data:string>>>>)")), lambda g: F.coalesce(g["instructions"], F.expr(kind))))
    calls = F.transform(
        F.concat(outer, inner),
        lambda i: F.struct(F.coalesce(i["programId"], F.get("account_keys", i["programIdIndex"])).alias("program"), i["data"].alias("data")),
    )
    named = F.transform(
        F.filter(strings("meta.logMessages"), lambda line: line.startswith("Program ") & line.contains(" invoke [")), lambda line: F.split(line, " ")[1]
    )
    programs = F.array_distinct(F.concat(F.array_compact(F.transform(calls, lambda i: i["program"])), named))
    return rows.select(
        "signature", "slot", "block_time", "success", "error", F.get("account_keys", F.lit(0)).alias("fee_payer"), "account_keys",
        programs.alias("programs"), calls.alias("calls"), c("meta.preBalances").alias("pre"), c("meta.postBalances").alias("post"),
        c("meta.preTokenBalances").alias("token_pre"), c("meta.postTokenBalances").alias("token_post"), strings("meta.logMessages").alias("logs"),
    )


HEAD = ["signature", "slot", "block_time", "success", "fee_payer"]


def sol_balance_deltas(tx: DataFrame) -> DataFrame:
    """Balance change per (transaction, account): first pre/post, summed change, zeros dropped."""
    zipped = F.arrays_zip(F.col("account_keys").alias("k"), F.col("pre").alias("a"), F.col("post").alias("b"))
    rows = tx.select(*HEAD, F.posexplode(zipped).alias("_i", "_z")).filter("_z.k is not null and _z.a is not null and _z.b is not null")
    return (
        rows.groupBy(*HEAD, F.col("_z.k").alias("address"))
        .agg(F.min_by("_z.a", "_i").alias("pre"), F.min_by("_z.b", "_i").alias("post"), F.sum(F.col("_z.b") - F.col("_z.a")).alias("delta"))
        .filter("delta <> 0")
    )


def token_balance_deltas(tx: DataFrame) -> DataFrame:
    """Token change per (transaction, owner, mint)."""

    def side(column: str, sign: int) -> DataFrame:
        entry = tx.select(*HEAD, F.explode(column).alias("_e"))
        amount = F.coalesce(F.col("_e.uiTokenAmount.amount").cast("decimal(38,0)"), F.lit(0))
        return entry.select(*HEAD, F.col("_e.owner").alias("owner"), F.col("_e.mint").alias("mint"), (amount * sign).alias("delta"))

    both = side("token_pre", -1).unionByName(side("token_post", 1)).filter("owner <> '' and mint <> ''")
    return both.groupBy(*HEAD, "owner", "mint").agg(F.sum("delta").cast("long").alias("delta")).filter("delta <> 0")


def decode_instruction_names(tx: DataFrame) -> DataFrame:
    """(signature, position, instruction) for the known instructions of the two programs."""
    calls = _program_calls(tx).withColumn("tag", F.hex(F.substring("payload", 1, 8)))
    names = F.create_map(*[F.lit(x) for n in INSTRUCTIONS for x in (discriminator("global", n).hex().upper(), n)])
    return calls.withColumn("instruction", F.element_at(names, F.col("tag"))).filter("instruction is not null").select("signature", "position", "instruction")


def _program_calls(tx: DataFrame) -> DataFrame:
    rows = tx.select(*HEAD, F.posexplode("calls").alias("position", "_c")).filter(F.col("_c.program").isin(LAUNCH_PROGRAM, POOL_PROGRAM) & (F.length("_c.data") > 0))
    return rows.select(*HEAD, "position", base58_to_binary(F.col("_c.data")).alias("payload")).filter("payload is not null")


def event_payloads(tx: DataFrame) -> DataFrame:
    """Event payloads from self-invoked instructions and from log lines, once per transaction."""
    inner = _program_calls(tx).select(*HEAD, "payload")
    lines = tx.select(*HEAD, F.explode(F.filter("logs", lambda x: x.startswith(LOG_PREFIX))).alias("_l"))
    logged = lines.select(*HEAD, F.expr(f"try_to_binary(trim(substring(_l, {len(LOG_PREFIX) + 1})), 'base64')").alias("payload")).filter("payload is not null")
    body = F.when(F.substring("payload", 1, 8) == F.lit(EVENT_TAG), F.expr("substring(payload, 9)")).otherwise(F.col("payload"))
    return inner.unionByName(logged).withColumn("payload", body).filter(F.length("payload") >= 8).dropDuplicates(["signature", "payload"])


def decode_events(payloads: DataFrame, name: str) -> DataFrame:
    """Events of one kind as a typed table."""
    return decode_payloads(payloads, EVENT_LAYOUTS[name], discriminator("event", name), HEAD)


def decode_accounts(raw: DataFrame, name: str) -> DataFrame:
    """Accounts of one kind; the data field is [text, encoding] with base64 or base58."""
    text, encoding = F.get("data", F.lit(0)), F.coalesce(F.get("data", F.lit(1)), F.lit("base64"))
    plain = raw.select("address", "owner", text.alias("_t"), encoding.alias("_e"))
    b64 = plain.filter("_e = 'base64'").select("address", "owner", F.expr("try_to_binary(_t, 'base64')").alias("payload"))
    b58 = plain.filter("_e = 'base58'").select("address", "owner", base58_to_binary(F.col("_t")).alias("payload"))
    return decode_payloads(b64.unionByName(b58), ACCOUNT_LAYOUTS[name], discriminator("account", name), ["address", "owner"])


def trades_from_events(trade: DataFrame, buys: DataFrame, sells: DataFrame, pools: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Curve trades and pool trades in one shape, failed transactions left out.

    Pool events name the pool; ``pools`` (pool, base_mint) gives the mint.
    """
    c = F.col
    explicit = S.known(c("quote_amount").cast("double"))
    raw = F.coalesce(explicit, c("sol_amount").cast("double"), F.lit(0.0))
    decimals = F.when(explicit.isNull() & c("quote_mint").isNull(), 9).otherwise(S.quote_decimals(c("quote_mint")))
    time = F.coalesce(S.known(c("timestamp")), c("block_time"))
    curve = trade.filter("success").select(
        "mint", c("user").alias("wallet"), "signature", "slot", time.alias("block_time"), F.lit(0).alias("leg"), F.coalesce("is_buy", F.lit(False)).alias("is_buy"),
        S.ui_amount(raw, decimals).alias("quote_amount"), F.coalesce(c("token_amount").cast("double"), F.lit(0.0)).alias("token_amount"),
        F.coalesce("mayhem_mode", F.lit(False)).alias("mayhem"), F.lit("bonding_curve").alias("venue"), "fee_payer", c("success").alias("tx_success"),
        c("real_token_reserves").cast("long").alias("real_token_reserves"),
    )

    def pooled(rows: DataFrame, is_buy: bool, quote: str, base: str) -> DataFrame:
        named = rows.filter("success").join(pools.select("pool", c("base_mint").alias("mint")), "pool")
        return named.select(
            "mint", c("user").alias("wallet"), "signature", "slot", time.alias("block_time"), F.lit(0).alias("leg"), F.lit(is_buy).alias("is_buy"),
            S.ui_amount(c(quote).cast("double"), F.lit(9)).alias("quote_amount"), F.coalesce(c(base).cast("double"), F.lit(0.0)).alias("token_amount"),
            F.lit(False).alias("mayhem"), F.lit("pumpswap").alias("venue"), "fee_payer", c("success").alias("tx_success"), F.lit(None).cast("long").alias("real_token_reserves"),
        )

    if pools is None:
        if buys is not None or sells is not None:
            raise ValueError("pool trades need the table of pools that names their mints")
        return curve, curve.limit(0)
    return curve, pooled(buys, True, "quote_amount_in", "base_amount_out").unionByName(pooled(sells, False, "quote_amount_out", "base_amount_in"))


# --- text ------------------------------------------------------------------------------------------

ADDRESS_PATTERN = "[1-9A-HJ-NP-Za-km-z]{32,44}"


def address_candidates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct address-shaped words of each text with the order of their first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ADDRESS_PATTERN), F.lit(0)))
    return texts.select(key, F.posexplode(found).alias("position", "address"))


def extract_addresses(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The candidates that decode to 32 bytes."""
    return address_candidates(texts, key, text).filter(base58_valid(F.col("address")))


def wrapped_rows(raw: DataFrame, column: str, element: str) -> DataFrame:
    """Rows of a JSON text that may be a list, ``{"data": [...]}`` or ``{"data": {"items": [...]}}``."""
    v = F.try_parse_json(F.col(column))
    kind = f"array<{element}>"
    rows = F.coalesce(*[F.try_variant_get(v, path, kind) for path in ("$", "$.data", "$.data.items")])
    return raw.select(*[c for c in raw.columns if c != column], F.explode(rows).alias("row"))
