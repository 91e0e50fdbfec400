"""Pitman-Yor scores: counts and base by brute force, probabilities that sum to one, held-out gain, odd rows."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, x, 3, "k") for i, t, x in rows], "doc_id long, text string, train boolean, n_tokens int, keys string")
    got = {r["id"]: r for r in lm.scored(docs, **more).collect()}
    counts = Counter(w for _, t, x in rows if x for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        own = tokens(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    return got


def test_cases(spark):
    rows = [(1, None, True), (2, "", False), (3, "The cat", True), (4, "the  CAT\n", False), (5, "É x", True), (6, "é x", None), (7, "word " * 30000, True), (8, "long" * 5000, False), (9, "\x0b", True)]
    got = check(spark, rows)
    assert got[3]["score"] == got[4]["score"] and got[1]["score"] == got[2]["score"] == got[9]["score"]


def test_no_training(spark):
    got = check(spark, [(1, "a b", False), (2, None, None)])
    assert got[1]["train_tokens"] == 0


def test_empty(spark):
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string, train boolean")).count() == 0


def test_blocks_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", (C.remainder("doc_id", 7) != 2).alias("train"))
    got = check(spark, [tuple(r) for r in docs.collect()])
    small = {r["id"]: r["score"] for r in lm.scored(docs, block_bytes=200_000).collect()}
    assert np.corrcoef([small[i] for i in got], [got[i]["score"] for i in got])[0, 1] > 0.999


def test_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", (C.remainder("doc_id", 7) != 2).alias("train"))
    held = lm.scored(docs).filter(C.remainder("id", 7) == 2).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.98 * held[1]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    text = rng.choice(np.frombuffer(b"abc ", np.uint8), 4000)
    trained, n = np.unique(lm.grams(text, np.array([len(text)])), return_counts=True)
    context = np.unique(trained >> np.uint64(8))[:50]
    keys = np.union1d(trained, (context[:, None] << np.uint64(8) | np.arange(256, dtype=np.uint64)).ravel())
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, trained)] = n
    rooms = lm.Restaurants(keys, counts, 2)
    low = rooms.levels[-1]["keys"]
    above = lm.one_byte_contexts(np.bincount((trained & np.uint64(0xFFFF)).astype(int), n, 65536))
    assert np.allclose(above.sum(axis=1), 1)
    for turn in range(4):
        p = rooms.sweep(above[(low >> np.uint64(8) & np.uint64(255)).astype(int), (low & np.uint64(255)).astype(int)], np.random.default_rng(turn))
        for c in context:
            assert math.isclose(p[(keys >> np.uint64(8)) == c].sum(), 1, rel_tol=1e-9)
        for level in rooms.levels:
            t, c = level["tables"], level["customers"]
            assert ((t <= c) & ((t > 0) == (c > 0))).all()


def test_seating_matches_the_exact_process():
    rng = np.random.default_rng(8)
    n, theta, a, p = 60, 1.5, 0.4, 0.3
    got = lm.seat(np.full(4000, n), np.full(4000, theta), a, np.full(4000, p), rng).mean()
    tables = np.ones(4000)
    for k in range(1, n):
        new = (theta + a * tables) * p
        tables += rng.random(4000) < new / (new + k - a * tables)
    assert abs(got - tables.mean()) < 0.03 * tables.mean()
