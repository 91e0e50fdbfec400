"""Quality rules against a direct computation."""

import math
import re
from collections import Counter

import xxhash

from mintweave.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def buckets(text):
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in WORD.findall(text or "")]
    pairs = [xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest() for a, b in zip(h, h[1:])]
    return [signed(x) % quality.BUCKETS for x in h + pairs]


def brute(rows, trusted, threshold):
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in trusted:
            good.update(buckets(t))
    r, g, a = sum(raw.values()), sum(good.values()), quality.SMOOTHING
    out = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        windows = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for d in range(3)}
        lines = [s for s in (t or "").split("\n") if WORD.search(s)]
        b = buckets(t)
        llr = sum(math.log((good[x] + a) / (g + a * quality.BUCKETS)) - math.log((raw[x] + a) / (r + a * quality.BUCKETS)) for x in b) / len(b) if b else 0.0
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out[i] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= threshold, round(llr, 9))
    return out


def check(spark, rows, trusted):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, bucket int, _words string")
    marks = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = {r[0]: (*r[1:8], round(r[8], 9)) for r in quality.assessed(docs, marks).collect()}
    want = brute(rows, set(trusted), quality.THRESHOLD)
    assert got == want


def test_cases(spark):
    plain = " ".join(f"word{i % 70} is{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n \t"), (4, "one"), (5, "a b"), (6, "a a a"), (7, "x y z x y z x"), (8, "same line\n\nsame line\nother\nsame line "), (9, "é ñ # <b>& | $$"), (10, plain), (11, plain), (12, "spam $$$ " * 80), (13, "A\x0bB\x0cC\rD " * 30)]
    check(spark, rows, [10, 11, 99])
    check(spark, rows, [])


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    good = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("quality = 1").select("doc_id").distinct().collect()]
    check(spark, [tuple(r) for r in docs], good)


def test_very_long(spark):
    text = " ".join(f"t{i % 4000}" for i in range(200_000))
    check(spark, [(1, text), (2, "y " * 50_000)], [1])


def test_empty(spark):
    assert quality.assessed(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).count() == 0
