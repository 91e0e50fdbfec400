"""Packing: every id in one piece, no gaps, little padding, and ids equal to the tokenizer's own."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mintweave.llm import packing

DEFINITION = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def check(spark, rows, padding=None):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, length int")
    tokenizer = Tokenizer.from_str(DEFINITION)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    found = packing.pack(docs, DEFINITION).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        own = ids[r["id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"]:r["start"] + r["length"]].tobytes())
    assert set(pieces) == set(ids)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(ids[i])
    spare = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        total += at
        spare += 0 if at & (at - 1) == 0 else 4096 - at
    if padding is not None:
        assert spare <= padding * total
    assert sorted(sequences) == list(range(len(sequences)))


def test_cases(spark):
    check(spark, [(1, None), (2, ""), (3, "Hello  World x"), (4, "I'll don't 123 İ café <|endoftext|>"), (5, "same"), (6, "same"), (7, "long word " * 9000), (8, "x" * 5000)], 0.0)


def test_special_tokens_in_texts(spark):
    """Each is its one id, as in the tokenizer's plain call: at both ends, side by side, inside words, and not in another case."""
    texts = ["x <|endoftext|> y", "<|endoftext|>", "<|startoftext|>a", "b<|endoftext|>", "<|endoftext|><|startoftext|>", "a<|endoftext|>b's <|ENDOFTEXT|> <|endof", "text|>", "", "e<|endoftext|>\u0301 <|endoftext|", "plain", "<|endoftext|>" * 5000]
    check(spark, list(enumerate(texts)))
    coder, tokenizer = packing.WordIds(DEFINITION), Tokenizer.from_str(DEFINITION)
    raw = [t.encode() for t in texts]
    ids, first = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    for k, text in enumerate(texts):
        assert ids[first[k]:first[k + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in docs], 0.02)


def test_one_length(spark):
    check(spark, [(i, "a " * 1364) for i in range(60)], 0.02)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), DEFINITION).count() == 0


def test_least_squares():
    parts = packing.combinations(16)
    assert all(sum(p) == 16 for p in parts) and len(set(parts)) == len(parts)
    goal = np.zeros(16)
    for p, n in ((parts[3], 50), (parts[9], 20), (parts[0], 7)):
        for b in p:
            goal[b - 1] += n
    x = packing.least_squares(parts, goal)
    made = np.zeros(16)
    for p, n in zip(parts, x):
        for b in p:
            made[b - 1] += n
    assert np.allclose(made, goal, atol=1e-6) and (x >= 0).all()
