"""Canonical schemas.  Operators accept any id type; these are the stored forms."""

from __future__ import annotations

TRADES = """mint STRING, wallet STRING, signature STRING, slot LONG, block_time LONG, leg INT, is_buy BOOLEAN,
quote_amount DOUBLE, token_amount DOUBLE, mayhem BOOLEAN, venue STRING, fee_payer STRING, tx_success BOOLEAN,
real_token_reserves LONG"""
LAUNCHES = """mint STRING, creator STRING, created_at LONG, create_signature STRING, create_slot LONG, name STRING,
symbol STRING, uri STRING, quote_mint STRING, is_mayhem BOOLEAN, curve_complete BOOLEAN, real_token_reserves LONG,
initial_real_tokens LONG, token_total_supply LONG, pool STRING, graduated_at LONG"""
SOL_DELTA = """signature STRING, slot LONG, block_time LONG, success BOOLEAN, fee_payer STRING, address STRING,
pre LONG, post LONG, delta LONG"""
TOKEN_DELTA = "signature STRING, slot LONG, block_time LONG, success BOOLEAN, owner STRING, mint STRING, delta LONG"
WALLET_TX = "address STRING, signature STRING, slot LONG, block_time LONG, err STRING"
TRANSFERS = """source STRING, recipient STRING, asset STRING, amount DOUBLE, signature STRING, slot LONG,
block_time LONG, recipient_before DOUBLE, recipient_after DOUBLE"""
ENTITIES = "address STRING, label STRING, entity_type STRING, source STRING, confidence DOUBLE, verify BOOLEAN"
HOLDERS = "mint STRING, owner STRING, token_account STRING, amount DOUBLE, provider STRING"

# Nested shape of one raw transaction document.
RAW_TX = """slot LONG, blockTime LONG,
transaction STRUCT<signatures: ARRAY<STRING>, message: STRUCT<accountKeys: ARRAY<STRING>,
  instructions: ARRAY<STRUCT<programIdIndex: INT, programId: STRING, data: STRING>>>>,
meta STRUCT<err: STRING, fee: LONG, preBalances: ARRAY<LONG>, postBalances: ARRAY<LONG>,
  preTokenBalances: ARRAY<STRUCT<owner: STRING, mint: STRING, uiTokenAmount: STRUCT<amount: STRING>>>,
  postTokenBalances: ARRAY<STRUCT<owner: STRING, mint: STRING, uiTokenAmount: STRUCT<amount: STRING>>>,
  loadedAddresses: STRUCT<writable: ARRAY<STRING>, readonly: ARRAY<STRING>>,
  innerInstructions: ARRAY<STRUCT<index: INT, instructions: ARRAY<STRUCT<programIdIndex: INT, programId: STRING, data: STRING>>>>,
  logMessages: ARRAY<STRING>>"""
RAW_ACCOUNT = "address STRING, owner STRING, lamports LONG, data ARRAY<STRING>"

# Order of trades on a tape; the columns after ``signature`` only break ties inside one transaction.
TAPE_ORDER = ["block_time", "slot", "signature", "leg", "wallet", "token_amount", "quote_amount"]
TAPE_TIES = TAPE_ORDER[1:]
