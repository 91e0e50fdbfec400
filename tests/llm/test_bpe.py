"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from mintweave.llm import bpe

DEFINITION = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="utf-8").read()


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bytes string")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(DEFINITION), special_tokens={})
    want = {}
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids)
    got = {r["id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], np.frombuffer(r["ids"], "<u4").tolist()) for r in bpe.encode(docs, DEFINITION, public_tokenizers.PATTERN, ids=True).collect()}
    assert got == want


def test_cases(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("abAB \n\t'séßñ漢🙂1,.$  ́") for _ in range(rng.randrange(60))) for _ in range(300)]
    long = ["a" * 127, "a" * 128, "ab" * 64, "x" * 3000, "".join(rng.choice("abcdefgh") for _ in range(5000)), " " * 700 + "x", "he'll " * 20000]
    rows = [(0, None), (1, ""), (2, " "), (3, "\x1c\x1d \x85"), *enumerate(noise + long, 4)]
    check(spark, rows)


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in docs])


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 400)
    check(spark, [(i, f"block {i} of words " * (i % 7)) for i in range(200)])


def test_empty(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), DEFINITION, public_tokenizers.PATTERN).count() == 0
