"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm import archives, bpe, collocations, hnsw, html_text, langmix, lm, minhash, packing, quality, quotes, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    out = minhash.near_duplicates(C.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def _lang_training(docs: DataFrame) -> DataFrame:
    return docs.filter(C.remainder("doc_id", 4) != 2)


@query
def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 2."""
    docs = C.table(spark, sf_dir, "documents")
    out = langmix.identify(docs, langmix.profiles(_lang_training(docs)))
    return out.select(F.col("id").alias("doc_id"), (C.remainder("id", 4) == 2).alias("held_out"), "lang_pred", "score", "proportions")


@query
def op7_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled folds other than 2."""
    docs = C.table(spark, sf_dir, "documents")
    marks = C.table(spark, sf_dir, "labels").filter(C.remainder("doc_id", 4) != 2)
    out = toxicity.score(docs, toxicity.fit(toxicity.labelled_sample(docs.select("doc_id", "text"), marks)))
    return out.select(F.col("id").alias("doc_id"), (C.remainder("id", 4) == 2).alias("held_out"), "score", "predicted", "margin")


def definition(name: str = "word_bpe_49k.json") -> str:
    """The tokenizer's file, read by the driver (a few MB) and sent to the workers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query
def op2_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(C.table(spark, sf_dir, "documents"), definition()).withColumnRenamed("id", "doc_id")


@query
def op1_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and n-gram likelihood ratio of every document; documents marked good are the trusted target."""
    trusted = C.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.assessed(C.table(spark, sf_dir, "documents"), trusted)


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every document, and what they decode to."""
    import public_tokenizers

    out = bpe.encode(C.table(spark, sf_dir, "documents"), definition("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


@query
def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    out = hnsw.near_duplicates(C.table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query
def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from the folds other than 2."""
    docs = C.table(spark, sf_dir, "documents").withColumn("train", C.remainder("doc_id", 7) != 2)
    out = lm.scored(docs)
    return out.select(F.col("id").alias("doc_id"), (C.remainder("id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(C.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query
def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of all conversations without quotes, with the message it answers."""
    return quotes.conversations(C.table(spark, sf_dir, "conversations"), unplaced=True)


@query
def op13_bloom_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling.spelling_variants(C.table(spark, sf_dir, "documents"), drop_every=31, min_letters=7, min_count=2, factor=10)


@query
def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language of all documents."""
    return collocations.collocations(C.table(spark, sf_dir, "documents"), min_count=100, longest=5, cover_percent=100, first=2000)


ORACLES["op11_toivonen_phrases"] = r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT id, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS body FROM texts),
lists AS (SELECT id, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT id, lang, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w1 FROM lists),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5
  FROM words WINDOW o AS (PARTITION BY id, piece ORDER BY i)),
phrases AS (
  SELECT lang, 1 AS size, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM runs WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM runs WHERE w5 IS NOT NULL),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size >= 2 AND f >= 100),
cuts AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM candidates),
parts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM cuts),
scores AS (
  SELECT p.lang, p.phrase, p.a, k, h.f AS l, t.f AS r, n, CAST((1000::HUGEINT * p.a * n) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM parts p JOIN counts h ON h.lang = p.lang AND h.phrase = head JOIN counts t ON t.lang = p.lang AND t.phrase = tail JOIN totals ON totals.lang = p.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, ws, size, unnest(generate_series(1, size)) AS i FROM candidates),
insides AS (SELECT lang, a, ws, size, i, unnest(generate_series(i, size)) AS j FROM spans),
inner_phrases AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer FROM insides WHERE j - i + 1 < size GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN inner_phrases i ON i.lang = l.lang AND i.phrase = l.phrase WHERE i.longer IS NULL OR 100 * i.longer < 100 * l.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@query
def op12_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged archives and read back."""
    return archives.round_trip(C.table(spark, sf_dir, "pages"))


ORACLES["op12_zip_archives"] = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, upper(sha1(body)) AS hex FROM sized),
digits AS (SELECT page_id, payload_bytes, hex, CAST('0x' || substr(hex, 1 + 5 * k, 5) AS BIGINT) AS part, k FROM hashed, range(8) t(k)),
coded AS (
  SELECT page_id, payload_bytes, string_agg(
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(part // 32768 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(part // 1024 % 32 AS INT) + 1, 1)
        || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(part // 32 % 32 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(part % 32 AS INT) + 1, 1), '' ORDER BY k) AS payload_digest
  FROM digits GROUP BY page_id, payload_bytes, hex),
largest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM largest
"""
