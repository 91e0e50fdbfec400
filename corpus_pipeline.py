"""A training-data pipeline over ``documents``: toxicity, language, near-duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that it is given, and returns the rows it keeps
with the columns of documents; the last returns packed pieces.  Toxicity is learned from the labelled
documents in ``sf_dir``, languages from the ``lang`` of the rows given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mintweave.llm import common as C
from mintweave.llm import langmix, minhash, packing, queries, toxicity
from mintweave.session import cut

#: Below this share of its main language a text is rejected as unidentified.
LANGUAGE_SHARE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose toxicity score reaches 0.3 go; null and empty texts stay.

    The model is learned from the labelled documents of ``sf_dir``, whatever rows are given.
    """
    known = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = toxicity.labelled_sample(known, C.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, toxicity.fit(sample))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of which no learned language makes up ``LANGUAGE_SHARE``, go."""
    return langmix.accepted(docs, langmix.profiles(docs), LANGUAGE_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate component stays."""
    return minhash.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining texts in sequences of at most 4096 tokens."""
    return packing.pack(docs, queries.definition()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Trained models, sketches and token ids have no SQL counterpart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
