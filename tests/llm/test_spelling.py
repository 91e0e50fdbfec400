import random
import re
import zlib
from collections import Counter

import numpy as np

from mintweave.llm import bloom
from mintweave.llm import spelling as S

LETTERS = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def plain_words(rows, drop, least, count):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if drop and h % drop == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= count}


def plain_variants(known, factor):
    near = {}
    for w in known:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + a + w[i + k:] for i in range(len(w) + 1) for a in LETTERS for k in (0, 1)}
        near[w] = [x for x in edits - {w} if x in known]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-known[x], x), default=None)
        if best is not None and known[best] >= factor * known[w]:
            form[w] = best
    out = {}
    for w in known:
        root = w
        while root in form:
            root = form[root]
        out[w] = (known[w], len(near[w]), form.get(w), known.get(form.get(w)), root)
    return out


def rows_of(frame):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdéÿÀ") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abÿ") + w[k + 1:], w.upper()])
            words.append(w)
        rows.append((i % 50, rng.choice([" ", "-", "’", "。"]).join(words)))
    rows += [(None, None), (None, ""), (7, "x" * 300 + " " + "x" * 299), (7, "x" * 300 + " " + "x" * 299), (3, "×÷×÷ ×÷×÷ 12_3")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int")
    for drop, least in ((3, 4), (0, 1), (31, 7)):
        known = plain_words(rows, drop, least, 2)
        got = rows_of(S.spelling_variants(docs, drop, least, 2, 3))
        assert got == plain_variants(known, 3)
    assert any(v[2] for v in plain_variants(plain_words(rows, 3, 4, 2), 3).values())


def test_saturated_filters_change_nothing(spark):
    words = ["abcdefg", "abcdefh", "abcdef", "bcdefg", "zzzzzzz", "abcdefgg"]
    frame = spark.createDataFrame([(w, 10 ** i) for i, w in enumerate(words)], "word string, n long")
    assert rows_of(S.variants(frame, 10, filter_blocks=1)) == rows_of(S.variants(frame, 10)) == plain_variants({w: 10 ** i for i, w in enumerate(words)}, 10)


def test_chain_of_forms_reaches_its_root(spark):
    known = {"a" * (3 + i): 2 * 10 ** i for i in range(9)}
    got = rows_of(S.variants(spark.createDataFrame(list(known.items()), "word string, n long"), 10))
    assert {v[4] for v in got.values()} == {"a" * 11} and got == plain_variants(known, 10)


def test_tie_takes_the_smallest_word(spark):
    got = rows_of(S.variants(spark.createDataFrame([("caaa", 50), ("baaa", 50), ("daaa", 5)], "word string, n long"), 10))
    assert got["daaa"] == (5, 2, "baaa", 50, "baaa") and got["caaa"][2] is None


def test_empty_tables(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), 31).collect() == []


def test_crc_of_spans():
    data = np.frombuffer(b"abc" * 100 + b"x", np.uint8)
    starts, ends = np.array([0, 3, 10, 0]), np.array([300, 4, 74, 1])
    heads = np.array([zlib.crc32(b"12:")] * 4, np.uint32)
    assert S.crc32s(data, starts, ends, heads).tolist() == [zlib.crc32(b"12:" + data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_filters_hold_every_key_and_few_others(spark):
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 3000)
    frame = spark.createDataFrame([(int(k) % 3, int(k)) for k in keys], "shard int, key long")
    built = bloom.build(frame)
    for s in range(3):
        assert bloom.holds(built[s], keys[keys % 3 == s].view(np.uint64)).all()
    assert bloom.holds(built[0], np.arange(10**6, dtype=np.uint64)).mean() < 0.02
    assert sum(bloom.sizes({1: 10**9, 2: 10**9}, 1 << 12).values()) <= 1 << 12
