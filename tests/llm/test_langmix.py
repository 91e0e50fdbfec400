"""Language mixtures: held-out accuracy, mixtures and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm import langmix


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = langmix.profiles(docs.filter(C.remainder("doc_id", 4) != 2))
    out = langmix.identify(docs, counts).join(docs.select("doc_id", "lang"), F.col("id") == docs["doc_id"]).collect()
    held = [r for r in out if r["lang_pred"] != "und"]
    assert len(out) == docs.count()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in out)




def test_mixture_and_edges(spark):
    rng = np.random.default_rng(0)
    words = {"aa": ["lor", "mip", "dol", "sat"], "bb": ["kruz", "vach", "schi", "ngen"], "cc": ["ouai", "eaux", "ille", "ment"]}
    text = lambda l, n: " ".join(rng.choice(words[l], n))
    train = [(i, text(l, 200), l, 1) for i, l in enumerate(["aa", "bb", "cc"] * 5)] + [(90, None, "aa", 1), (91, "x", None, 1)]
    counts = langmix.profiles(spark.createDataFrame(train, "doc_id long, text string, lang string, n int"))
    assert list(counts) == ["aa", "bb", "cc"]
    rows = [(1, text("aa", 50)), (2, text("aa", 60) + " " + text("cc", 60)), (3, None), (4, ""), (5, "123 $$$ \n"), (6, "a"), (7, text("bb", 20000)), (1, "kruz vach")]
    out = langmix.identify(spark.createDataFrame([(i, t, "zz", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, score double"), counts).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert {r["lang_pred"] for r in by[1]} == {"aa", "bb"}
    two = dict(zip(counts, by[2][0]["proportions"]))
    assert two["bb"] == 0 and abs(two["aa"] + two["cc"] - 1) < 1e-3 and 0.3 < two["aa"] < 0.7
    assert all(by[i][0]["lang_pred"] == "und" and by[i][0]["score"] == 0 for i in (3, 4, 5))
    assert by[6][0]["lang_pred"] in counts
    assert by[7][0]["lang_pred"] == "bb" and by[7][0]["score"] > 0.99


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langmix.profiles(none) == {}
    out = langmix.identify(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), {}).collect()
    assert [(r["lang_pred"], r["score"]) for r in out] == [("und", 0.0)]
    assert langmix.identify(none, {}).count() == 0


def test_against_plain_em(spark):
    """The array EM equals a loop over one text."""
    rng = np.random.default_rng(1)
    likely = rng.random((40, 3)).astype(np.float32)
    count = rng.integers(1, 5, 40).astype(np.float32)
    pi = np.full(3, 1 / 3)
    for _ in range(langmix.ROUNDS):
        w = likely * pi
        pi = (w / w.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
    got, fit = langmix._proportions(likely, count, np.array([0]), np.zeros(40, int), np.ones((1, 3), np.float32))
    assert np.allclose(got[0], pi, atol=1e-4)
    assert np.allclose(fit[0], (count * np.log((likely * pi).sum(1))).sum(), rtol=1e-4)
