"""Decode jobs against payloads written by a separate small encoder."""

import base64
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from mintweave.sources import decode as X
from mintweave.sources import schemas

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def key(n):
    return hashlib.sha256(f"key{n}".encode()).digest()


def b58(data):
    n, out = int.from_bytes(data, "big"), ""
    while n > 0:
        out = ALPHABET[n % 58] + out
        n //= 58
    for byte in data:
        if byte:
            break
        out = "1" + out
    return out


def text(s):
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def tag(kind, name):
    return hashlib.sha256(f"{kind}:{name}".encode()).digest()[:8]


def trade_head(user=key(2), sol=2_000_000_000, buy=1, mayhem=0):
    body = key(1) + struct.pack("<QQ?", sol, 5_000_000, buy) + user + struct.pack("<q4Q", 1_750_000_009, 1, 2, 3, 790_000_000_000_000)
    body += key(3) + struct.pack("<QQ", 95, 7) + key(4) + struct.pack("<QQ?QQQq", 5, 6, 1, 0, 0, 0, 8) + text("buy") + struct.pack("<?4Q", mayhem, 1, 2, 3, 4)
    return tag("event", "TradeEvent") + body


def tail(quote=key(9), amount=1_500_000):
    return struct.pack("<I", 2) + b"\x07" * 68 + quote + struct.pack("<3Q", amount, 11, 12)


def payloads(spark, *rows):
    data = [(f"s{i}", 1, 10, True, "payer", bytearray(p)) for i, p in enumerate(rows)]
    return spark.createDataFrame(data, "signature string, slot long, block_time long, success boolean, fee_payer string, payload binary")


def test_trade_event(spark):
    full, short, cut = trade_head() + tail(), trade_head(), trade_head()[:8 + 32 + 16]
    rows = {r.signature: r for r in X.decode_events(payloads(spark, X.EVENT_TAG + full, short, cut, b"12345678rest"), "TradeEvent").collect()}
    assert set(rows) == {"s0", "s1", "s2"}
    a = rows["s0"]
    assert (a.mint, a.user, int(a.sol_amount), a.is_buy, a.timestamp, a.ix_name) == (b58(key(1)), b58(key(2)), 2_000_000_000, True, 1_750_000_009, "buy")
    assert (a.quote_mint, int(a.quote_amount), int(a.real_quote_reserves)) == (b58(key(9)), 1_500_000, 12)
    assert rows["s1"].quote_mint is None and int(rows["s1"].buyback_fee) == 4
    assert int(rows["s2"].token_amount) == 5_000_000 and rows["s2"].is_buy is None


def test_create_event_and_name_only_event(spark):
    body = text("Ünï") + text("SYM") + text("http://x") + b"".join(key(i) for i in range(5, 9)) + struct.pack("<q4Q", -5, 2**64 - 1, 2, 3, 4) + key(1) + b"\x01\x00" + key(0) + struct.pack("<Q", 9)
    df = payloads(spark, tag("event", "CreateEvent") + body, tag("event", "UpdateMayhemVirtualParamsEvent") + b"??")
    r = X.decode_events(df, "CreateEvent").first()
    assert (r.name, r.timestamp, int(r.virtual_token_reserves), r.is_mayhem_mode, r.is_cashback_enabled) == ("Ünï", -5, 2**64 - 1, True, False)
    assert [x.signature for x in X.decode_events(df, "UpdateMayhemVirtualParamsEvent").collect()] == ["s1"]


@pytest.mark.parametrize("encoding", ["base64", "base58"])
def test_accounts(spark, encoding):
    raw = tag("account", "BondingCurve") + struct.pack("<5Q?", 1, 2, 3, 4, 5, True) + key(1) + b"\x00\x01" + bytes(32)
    shown = base64.b64encode(raw).decode() if encoding == "base64" else b58(raw)
    df = spark.createDataFrame([("a", "p", 1, [shown, encoding]), ("b", "p", 1, ["!!", "base64"])], schemas.RAW_ACCOUNT)
    rows = X.decode_accounts(df, "BondingCurve").collect()
    assert [(r.address, int(r.real_token_reserves), r.complete, r.creator, r.quote_mint) for r in rows] == [("a", 3, True, b58(key(1)), "1" * 32)]
    pool = tag("account", "Pool") + struct.pack("<BH", 1, 2) + b"".join(key(i) for i in range(6)) + struct.pack("<Q", 7) + key(6) + b"\x00\x00" + (-3).to_bytes(16, "little", signed=True)
    df = spark.createDataFrame([("p", "q", 1, [base64.b64encode(pool).decode(), "base64"])], schemas.RAW_ACCOUNT)
    r = X.decode_accounts(df, "Pool").first()
    assert (r.base_mint, int(r.lp_supply), int(r.virtual_quote_reserves)) == (b58(key(1)), 7, -3)


@pytest.fixture(scope="module")
def tx(spark, tmp_path_factory):
    buy = tag("global", "buy") + b"args"
    event = trade_head() + tail(amount=0)
    doc = {
        "slot": 5, "blockTime": 77,
        "transaction": {"signatures": ["sig"], "message": {"accountKeys": ["payer", "w", X.LAUNCH_PROGRAM, "w"], "instructions": [{"programIdIndex": 2, "data": b58(buy)}, {"programId": "Other", "data": "x0"}]}},
        "meta": {
            "err": None, "preBalances": [100, 10, 1, 10], "postBalances": [40, 70, 1, 15],
            "preTokenBalances": [{"owner": "w", "mint": "M", "uiTokenAmount": {"amount": "5"}}, {"owner": "", "mint": "M", "uiTokenAmount": {"amount": "1"}}],
            "postTokenBalances": [{"owner": "w", "mint": "M", "uiTokenAmount": {"amount": "25"}}, {"owner": "v", "mint": "M", "uiTokenAmount": {"amount": "3"}}],
            "loadedAddresses": {"writable": ["lw"], "readonly": ["lr"]},
            "innerInstructions": [{"index": 0, "instructions": [{"programIdIndex": 2, "data": b58(X.EVENT_TAG + event)}]}],
            "logMessages": ["Program Logged invoke [1]", "Program data: " + base64.b64encode(event).decode(), "Program data: ???", "Program log: hi"],
        },
    }
    failed = {"slot": None, "transaction": {"signatures": ["bad"], "message": {"accountKeys": ["p2"]}}, "meta": {"err": "boom"}}
    path = tmp_path_factory.mktemp("raw") / "tx.json"
    path.write_text("\n".join(json.dumps(d) for d in (doc, failed, {"slot": 1, "transaction": {"signatures": []}})))
    return X.decode_transactions(spark.read.schema(schemas.RAW_TX).json(str(path)))


def test_transaction(tx):
    rows = {r.signature: r for r in tx.collect()}
    assert set(rows) == {"sig", "bad"}
    r = rows["sig"]
    assert (r.fee_payer, r.success, r.block_time) == ("payer", True, 77)
    assert r.account_keys[-2:] == ["lw", "lr"]
    assert set(r.programs) == {X.LAUNCH_PROGRAM, "Other", "Logged"}
    assert (rows["bad"].success, rows["bad"].slot) == (False, 0)


def test_balances(tx):
    sol = {r.address: (r.pre, r.post, r.delta) for r in X.sol_balance_deltas(tx).collect()}
    assert sol == {"payer": (100, 40, -60), "w": (10, 70, 65)}
    assert {(r.owner, r.delta) for r in X.token_balance_deltas(tx).collect()} == {("w", 20), ("v", 3)}


def test_events_are_read_once(tx):
    events = X.event_payloads(tx)
    assert events.count() == 1 + 1  # the event, and the buy instruction's own data
    trade = X.decode_events(events, "TradeEvent")
    curve, _ = X.trades_from_events(trade, None, None)
    r = curve.collect()
    assert len(r) == 1
    assert (r[0].quote_amount, r[0].token_amount, r[0].venue, r[0].block_time) == (2.0, 5_000_000.0, "bonding_curve", 1_750_000_009)
    assert [x.instruction for x in X.decode_instruction_names(tx).collect()] == ["buy"]


def test_addresses(spark):
    good = b58(key(1))
    df = spark.createDataFrame([(1, f"see {good}, again {good} and {'1' * 33}x and short")], "id long, body string")
    assert [(r.address, r.position) for r in X.extract_addresses(df, "id", "body").collect()] == [(good, 0)]


def test_wrapped_json(spark):
    rows = [("a", '[{"owner": "x"}]'), ("b", '{"data": [{"owner": "y"}]}'), ("c", '{"data": {"items": [{"owner": "z"}]}}'), ("d", "nonsense")]
    df = spark.createDataFrame(rows, "mint string, body string")
    assert {(r.mint, r.row.owner) for r in X.wrapped_rows(df, "body", "struct<owner:string>").collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
