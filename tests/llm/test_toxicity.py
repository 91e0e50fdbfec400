"""String-kernel toxicity: kernel values by definition, gapped insults, held-out quality, odd rows."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm import toxicity as T


def slow_kernel(a, b):
    def features(s):
        out = {}
        for c in combinations(range(len(s)), 4):
            if c[-1] - c[0] < T.SPAN:
                key = bytes(s[i] for i in c)
                out[key] = out.get(key, 0) + T.DECAY ** (c[-1] - c[0] - 3)
        return out

    norm = lambda s: sum(T.DECAY ** (2 * (c[-1] - c[0] - 3)) for c in combinations(range(len(s)), 4) if c[-1] - c[0] < T.SPAN) ** 0.5
    x, y = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (norm(a) * norm(b))


def test_kernel():
    words = [b"stupid", b"stxupid", b"worthless", b"s.t.upid", b"banana", b"abcd"]
    got = T._similarity(words, words)
    want = [[slow_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, atol=1e-3)


def test_folding_is_the_machine():
    positive, negative = [b"stupid", b"moronic"], [b"student", b"morning", b"plain"]
    weights, bias = T.train(positive, negative)
    data = np.frombuffer(b" ".join(positive + negative), np.uint8)
    tight, starts, ends, _ = T.closed_up(data, np.array([0, len(data)]))
    value = T.margins(tight, starts, ends, weights, bias)
    assert (value[:2] > 0.5).all() and (value[2:] < -0.5).all()


def test_closed_up():
    raw = "a s t u p ok\nx".encode() + b"i d"
    data = np.frombuffer(raw, np.uint8)
    offsets = np.array([0, len(raw) - 3, len(raw)])
    tight, starts, ends, first = T.closed_up(data, offsets)
    assert [tight[a:b].tobytes() for a, b in zip(starts, ends)] == [b"astup", b"ok", b"x", b"id"]
    assert first.tolist() == [0, 3, 4]


def corpus(rng, n):
    clean = ["".join(rng.choice(list("abcdefgilmnoprstu"), rng.integers(3, 9))) for _ in range(600)]
    for i in range(n):
        words = list(rng.choice(clean, rng.integers(5, 80)))
        bad = i % 4 == 0
        if bad:
            words.insert(int(rng.integers(len(words))), str(rng.choice(["stupid", "worthless", "disgusting"])))
        yield i, " ".join(words), int(bad)


def test_gapped_insults(spark):
    rows = list(corpus(np.random.default_rng(2), 800))
    model = T.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    cases = [(1, "you are stupid now"), (2, "you are stu*pid now"), (3, "s t u p i d people"), (4, "WORTHLESS stuff"), (5, "worthlless stuff"), (6, "a plain student table"), (7, ""), (8, None), (9, " \n"), (10, "zz " * 50000 + "disgusting")]
    docs = spark.createDataFrame([(i, t, 1.0, 1) for i, t in cases], "doc_id long, text string, margin double, label int")
    got = {r["id"]: r for r in T.score(docs, model).collect()}
    assert [i for i in got if got[i]["predicted"]] == [1, 2, 3, 4, 5, 10]
    assert got[7]["score"] == got[8]["score"] == got[9]["score"] < 0.3
    assert sorted(r[0] for r in T.accepted(docs, model).select("doc_id").collect()) == [6, 7, 8, 9]


def test_no_labels(spark):
    for rows in ([], [(1, "some text here", 0)], [(1, None, None)]):
        model = T.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
        out = T.score(spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string"), model).collect()
        assert len(out) == 2 and len({r["score"] for r in out}) == 1 and 0 <= out[0]["score"] <= 1


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    both = docs.join(marks, "doc_id")
    model = T.fit(both.filter(C.remainder("doc_id", 4) != 2))
    held = both.filter(C.remainder("doc_id", 4) == 2)
    rows = T.score(held, model).join(held.select("doc_id", "toxic"), F.col("id") == F.col("doc_id")).collect()
    found = sum(r["predicted"] and r["toxic"] for r in rows)
    assert found >= 0.4 * sum(r["toxic"] for r in rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.02 * len(rows)
