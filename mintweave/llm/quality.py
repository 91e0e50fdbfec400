"""Quality rules: base measures, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to ``BUCKETS`` counters, once over the trusted texts and once over the whole
corpus.  A text's score is the mean over its n-grams of ``log P(trusted) - log P(corpus)``; it is kept if the
base rules pass and the score reaches ``THRESHOLD``.

DataFrame functions only.  The counters reach the scoring pass as one array (a constant of
``BUCKETS`` doubles); the trusted ids are a bounded, hashed choice, so nothing that grows is broadcast and
no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C

BUCKETS = 1 << 16
THRESHOLD = -0.15
SMOOTHING = 0.5
#: Most trusted texts that the target counts are taken from (a hashed choice beyond it).
TRUSTED = 20_000


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than 0x20 and 0x09-0x0D; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _steps(first: int, last: Column) -> Column:
    """``first .. last``, empty when ``last`` is lower."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base columns, ``_hashes`` (one per word) and ``base_failed``.

    Repeated three-word windows are found by sorting (hash, position) packed in one long and comparing the
    words of neighbours, so the cost is that of a sort however often a window repeats.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(source, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_words", words_of(F.col(text))).withColumn("_lines", lines)
    n = F.size("_words")
    out = out.select(
        "*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(source) - F.length(F.regexp_replace(source, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.ceil(F.log2(n + 2)).cast("int").alias("_bits"),
    ).drop("_lines")
    at = lambda name, i: F.get(F.col(name), i)
    window = lambda i: F.xxhash64(at("_hashes", i), at("_hashes", i + 1), at("_hashes", i + 2))
    mask = F.expr("shiftleft(1L, _bits) - 1")
    packed = F.transform(_steps(0, n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(F.col("_mask"))).bitwiseOR(i.cast("long")))
    out = out.withColumn("_mask", mask).withColumn("_sorted", F.sort_array(packed))

    def spot(j: Column) -> Column:
        return at("_sorted", j).bitwiseAND(F.col("_mask")).cast("int")

    def alike(j: Column, k: Column) -> Column:
        near = at("_sorted", j).bitwiseXOR(at("_sorted", k)).bitwiseAND(F.bitwise_not(F.col("_mask"))) == 0
        same = [at("_words", spot(j) + d) == at("_words", spot(k) + d) for d in range(3)]
        return F.coalesce(near & same[0] & same[1] & same[2], F.lit(False))

    # a neighbour outside the array is null, hence unlike
    repeated = F.filter(_steps(0, F.size("_sorted") - 1), lambda j: alike(j, j - 1) | alike(j, j + 1))
    out = out.withColumn("_spots", F.sort_array(F.transform(repeated, spot)))
    gap = lambda j: F.least(F.lit(3), F.coalesce(at("_spots", j + 1) - at("_spots", j), F.lit(3)))
    covered = F.aggregate(_steps(0, F.size("_spots") - 1), F.lit(0).cast("long"), lambda a, j: a + gap(j))
    out = out.withColumn("n_repeat_words", covered).drop("_words", "_sorted", "_spots", "_mask", "_bits")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def grams(hashes: str = "_hashes") -> Column:
    """Buckets of all words and of all pairs of neighbours."""
    pairs = F.transform(_steps(1, F.size(hashes) - 1), lambda i: F.xxhash64(F.get(F.col(hashes), i - 1), F.get(F.col(hashes), i)))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: ``ratios``, the log ratio of every bucket.  ``trusted`` holds ids in ``key``; null ids are ignored."""
    chosen = trusted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias("_trusted")).orderBy(F.xxhash64(key), key).limit(TRUSTED)
    rows = docs.select(key, F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)).alias("_hashes"))
    rows = rows.join(F.broadcast(chosen), key, "left").select("_trusted", F.explode(grams()).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "good"])
    whole = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("c"), F.sum("raw").alias("r"), F.sum("good").alias("g"))
    share = lambda x, total: F.log((x + SMOOTHING) / (F.col(total) + SMOOTHING * BUCKETS))
    return whole.select(F.transform("c", lambda x: share(x["good"], "g") - share(x["raw"], "r")).alias("ratios"))


def assessed(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, the base columns, ``base_failed``, ``kept`` and ``llr`` of every text.

    A null, empty or blank text has no words: it fails the base rules and its ``llr`` is 0.  Without trusted
    texts all ratios follow from smoothing alone.  Rows are kept one for one; other columns are not read.
    """
    weights = C.constant(ratios(docs, trusted, key, text))
    out = measured(docs.select(key, text), text).withColumn("_grams", grams())
    total = F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    score = F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(0.0)
    out = out.withColumn("llr", score)
    return out.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr")
