"""Rows without id: each stays, and changes nothing for the others."""

from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mintweave.llm import bpe, hnsw, lm, minhash, packing

WORDS = " ".join(f"w{i}" for i in range(40))
ROWS = [(1, WORDS), (2, WORDS + " more"), (None, WORDS), (None, WORDS), (2**60 + 1, "alone here"), (None, None), (None, "tok " * 5000), (3, "x y " * 3000)]


def docs(spark):
    return spark.createDataFrame([(*r, "clash", 7) for r in ROWS], "doc_id long, text string, body string, start int")


def test_minhash(spark):
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark)).collect()), key=repr)
    assert len(got) == len(ROWS)
    assert {k: c for k, _, c in got if k is not None} == {1: 1, 2: 1, 3: 3, 2**60 + 1: 2**60 + 1}
    assert sorted(n for k, n, _ in got if k is None) == [0, 1, 36, 36] and all(c is None for k, _, c in got if k is None)


def test_packing(spark):
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(definition)
    found = packing.pack(docs(spark), definition).collect()
    assert "body" not in found[0]
    held, sequences = defaultdict(int), defaultdict(list)
    for r in found:
        held[r.id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(int)
    for k, t in ROWS:
        want[k] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert held == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_scores(spark):
    rows = docs(spark).withColumn("train", F.col("text").isNotNull())
    got = lm.scored(rows).collect()
    assert sorted((r.id for r in got), key=repr) == sorted((k for k, _ in ROWS), key=repr)
    by_id = {r.id: r for r in got if r.id is not None}
    copies = [r for r in got if r.id is None and r.n_tokens == 41]
    assert len(copies) == 2 and all(abs(r.score - by_id[1].score) < 1e-9 for r in copies)


def test_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted(((r.id, r.n_links, r.component_id) for r in hnsw.near_duplicates(table).collect()), key=repr)
    assert got == [(1, 1, 1), (2, 1, 1), (None, 0, None), (None, 0, None)]


def test_byte_pairs(spark):
    definition = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="utf-8").read()
    got = bpe.encode(docs(spark), definition, public_tokenizers.PATTERN).collect()
    assert sorted((r.id for r in got), key=repr) == sorted((k for k, _ in ROWS), key=repr)
