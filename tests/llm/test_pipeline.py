"""The pipeline's stages: what each drops, and the columns that it keeps."""

import corpus_pipeline
import numpy as np
from mintweave.llm import langmix, minhash, toxicity
from mintweave.session import cut
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "packing"]
    marks = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect()}
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = cut(stage(spark, docs, SMALL), name)
        assert kept.columns == columns
        after = {r[0] for r in kept.select("doc_id").collect()}
        assert after <= before and kept.count() == len(after)
        if name == "toxicity":
            gone = before - after
            assert sum(marks.get(i) == 0 for i in gone) <= 0.03 * len(before)
            assert sum(marks.get(i) == 1 for i in gone) >= 0.5 * sum(v == 1 for v in marks.values())
        if name == "language":
            assert len(before - after) < 0.02 * len(before)
        if name == "near_duplicates":
            want = {r["id"] for r in minhash.near_duplicates(docs).filter("id = component_id").collect()}
            assert after == want
        docs, before = kept, after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == before


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (None, "some words here", "en", "s", 3), (4, "some words here", "en", "s", 3), (5, "some words here", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert toxicity.accepted(docs, model).count() == 6
    assert sorted(r[0] or 0 for r in langmix.accepted(docs, langmix.profiles(docs), 0.5).select("doc_id").collect()) == [0, 4, 5]
    assert sorted(r[0] or 0 for r in minhash.representatives(docs).select("doc_id").collect()) == [0, 1, 2, 3, 4]


def test_unlabelled_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    toxic = spark.read.parquet(f"{SMALL}/labels.parquet").filter("toxic = 1").select("doc_id").distinct()
    new = docs.join(toxic, "doc_id", "left_semi").withColumn("doc_id", F.col("doc_id") + 10_000_000)
    total = new.count()
    assert corpus_pipeline.drop_toxic(spark, new, SMALL).count() <= 0.5 * total


def test_one_sided_labels(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "some words here", "en", "s", 15), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, "other words there", "en", "s", 17)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in (1, 4, 7)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 4


def test_blank_texts_stay(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0, 0.0, 5.0)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "words")], "doc_id long, text string")
    assert sorted(r[0] for r in toxicity.accepted(docs, model).collect()) == [1, 2, 3]


def test_bound_counts_documents(spark):
    docs = spark.createDataFrame([(k, "text") for k in range(20)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, 0) for k in range(2000)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, marks, max_texts=20).count() == 20


def test_languages_do_not_depend_on_the_step(spark, monkeypatch):
    """Proportions are made in steps of their own, smaller ones than the counts: each text alone decides its language."""
    rows = [(i, "the cat sat on the mat again " * 3 if i % 2 else "der hund und die katze sind hier " * 3, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None, None), (41, "12 34", None)], "doc_id long, text string, lang string")
    counts = langmix.profiles(docs)
    assert sorted(r.doc_id for r in langmix.accepted(docs, counts, 0.5).collect()) == list(range(40))
    monkeypatch.setattr(langmix, "MIX_STEP", 64)
    assert sorted(r.doc_id for r in langmix.accepted(docs, counts, 0.5).collect()) == list(range(40))
