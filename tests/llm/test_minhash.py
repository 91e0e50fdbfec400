"""HyperMinHash near duplicates against brute force on whole sets."""

import re
from collections import defaultdict

import numpy as np

from mintweave.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posting = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posting[g].append(i)
    shared = defaultdict(int)
    for members in posting.values():
        for x in range(len(members)):
            for y in range(x):
                shared[members[y], members[x]] += 1
    for (a, b), k in shared.items():
        if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n int")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, long), (8, long.replace("w777 ", "other ")), (9, "É one"), (10, "é one")]
    check(spark, rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0


def test_chains_and_sizes(spark):
    rng = np.random.default_rng(5)
    rows, at = [], 0
    for size in (6, 12, 40, 200, 600, 690, 1500):
        base = [f"a{x}" for x in rng.integers(0, 10**6, size)]
        for step in range(12):
            words = list(base)
            for spot in rng.choice(size, max(0, size * step // 120), replace=False):
                words[spot] = f"z{rng.integers(0, 10**9)}"
            rows.append((at, " ".join(words)))
            at += 1
        drift = list(base)
        for _ in range(8):
            for spot in rng.choice(size, max(1, size // 50), replace=False):
                drift[spot] = f"y{rng.integers(0, 10**9)}"
            rows.append((at, " ".join(drift)))
            at += 1
    check(spark, rows)


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in docs])
