"""Phrase collocations by Toivonen's sampling algorithm.

A sample of the documents proposes phrases: those that reach a lowered threshold in it.  One pass over all
documents counts the proposed phrases and their negative border exactly.  A phrase belongs to the border when it
was not proposed, but both its parts of one word less were (every single word does), so it is recognised where it
stands and the border is never listed.  Border phrases that turn out frequent are failures of the sample: they join the proposal
and an expansion pass counts the border that they open, and what that border would open in turn, so one such
pass closes the search.  Counts of contiguous phrases never exceed those of their parts, so then every frequent
phrase has been counted.

Phrases are 64-bit hashes of their words and language until they are known to be frequent.  Tasks know the proposal as a Bloom filter
of bounded size (``filter_blocks``): a phrase that passes wrongly is counted too, exactly, and changes no result; a larger proposal
than the filter is made for costs shuffled counts, not phrases.  Counts are summed per step of text, then by Spark before and
after the shuffle, so a phrase with a third of all occurrences is one row per task.  One last pass spells out the frequent phrases
and the hashes of their parts, which are then joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintweave.llm import bloom
from mintweave.llm import common as C
from mintweave.llm.spelling import gathered
from mintweave.session import cut

#: Bytes of text of one vectorised step.
STEP = 1 << 20
#: Share of the documents that proposes, and the share of the threshold that a proposed phrase reaches there.
SAMPLE, LOWERED = 0.125, 0.5
#: Low bits of ``info`` that hold a phrase's number of words; the others name a text that holds it.
SIZE_BITS = 4
#: Blocks of a filter at least, so that later keys find room.
LEAST = 1 << 14
COUNTS = "key long, info long, n long"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def language_keys(values: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Each language (null: ``und``) and a 64-bit key of it."""
    names = [v if v is not None else "und" for v in values]
    keys = {v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in set(names)}
    return names, np.array([keys[v] for v in names], np.uint64)


class Words:
    """The words of one step of texts: spans, hashes by language, piece numbers, and hashes of runs of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray) -> None:
        self.data = data = C.LOWER[data]
        broken = _BREAK[data]
        solid = ~(_BLANK[data] | broken)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.append(False, solid)[:-1] & ~edge[:-1]
        after = np.append(solid, False)[1:] & ~edge[1:]
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(broken)[self.starts] + self.text
        self.language = languages
        with np.errstate(over="ignore"):
            self.runs = {1: C.mix(C.word_hashes(data, self.starts, self.ends) + languages[self.text])}
            # A text's place is a hash of its words, the same in every pass.
            sums = np.append(np.uint64(0), np.cumsum(self.runs[1]))
            first = np.searchsorted(self.text, np.arange(len(offsets)))
            self.places = C.mix(sums[first[1:]] - sums[first[:-1]]) >> np.uint64(SIZE_BITS + 1)

    def run(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on (fewer entries than words; may cross pieces)."""
        if size not in self.runs:
            shorter, n = self.run(size - 1), len(self.starts) - size + 1
            with np.errstate(over="ignore"):
                self.runs[size] = C.mix(shorter[:max(n, 0)] * np.uint64(0x9E3779B97F4A7C15) + self.runs[1][size - 1:])
        return self.runs[size]

    def whole(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on lie in one piece."""
        n = max(len(self.starts) - size + 1, 0)
        return self.piece[:n] == self.piece[size - 1:]


def _steps(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of the words of every step; state of ``work`` lasts for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for batch in batches:
            names, keys = language_keys(batch.column(1).to_pylist())
            for at, end, data, offsets in C.text_steps(batch, "text", STEP):
                yield from one(Words(data, offsets, keys[at:end]), names[at:end])
        C.released()

    return C.bounded(docs).select("text", "lang").mapInArrow(run, schema)


def _counted(words: Words, found: dict[int, np.ndarray | slice]) -> pa.RecordBatch:
    """Distinct keys of the runs of each size that begin at the given words, how often each occurs, and a text that has it (``info``)."""
    out = []
    for size, at in found.items():
        at = np.arange(len(words.run(size)))[at] if isinstance(at, slice) else np.flatnonzero(at)
        keys = words.run(size)[at]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        info = words.places[words.text[at[order[first]]]] << np.uint64(SIZE_BITS) | np.uint64(size)
        out.append((keys[first], info, np.diff(np.append(first, len(keys)))))
    return _counts(*(np.concatenate(c) for c in zip(*out)))


def _counts(key: np.ndarray, info: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(info.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "info", "n"])


def _languages(words: Words) -> pa.RecordBatch:
    """The number of words of each language, of size 0."""
    key, n = np.unique(words.language[words.text], return_counts=True)
    return _counts(key, np.zeros(len(key), np.uint64), n)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("info").alias("info"), F.sum("n").alias("n"))


def size_of(info: str = "info") -> Column:
    """The number of words (0: a language) in ``info``."""
    return F.col(info).bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def proposed(sample: DataFrame, least: int, longest: int, filter_blocks: int) -> DataFrame:
    """``key`` of every phrase that occurs ``least`` times or more in the sample: words and pairs first, then the runs of such pairs."""

    def short():
        def work(words: Words, _: list[str]) -> Iterator[pa.RecordBatch]:
            yield _counted(words, {1: slice(None), 2: words.whole(2)})

        return work

    first = cut(_summed(_steps(sample, short, COUNTS)).filter(F.col("n") >= least), "proposed")
    pairs = _filter(sample, first.filter(size_of() == 2), filter_blocks)

    def long():
        def work(words: Words, _: list[str]) -> Iterator[pa.RecordBatch]:
            good, found = bloom.holds(pairs.value, words.run(2)), {}
            for size in range(3, longest + 1):
                n = max(len(good) - size + 2, 0)
                own = words.whole(size)
                for k in range(size - 1):
                    own &= good[k:k + n]
                found[size] = own
            yield _counted(words, found)

        return work

    if longest < 3:
        return first.select("key")
    return first.unionByName(_summed(_steps(sample, long, COUNTS)).filter(F.col("n") >= least)).select("key")


def _filter(frame: DataFrame, keys: DataFrame, filter_blocks: int):
    """A broadcast Bloom filter of ``key``."""
    bits = bloom.build(keys.select(F.lit(0).alias("shard"), "key"), filter_blocks, min(LEAST, filter_blocks)).get(0, np.zeros(LEAST, np.uint64))
    return frame.sparkSession.sparkContext.broadcast(bits)


def _opened(words: Words, size: int, parts: np.ndarray) -> np.ndarray:
    """Whether both runs of one word less are among ``parts`` (flags of these), within one piece."""
    n = max(len(words.starts) - size + 1, 0)
    return words.whole(size) & parts[:n] & parts[1:]


def counted(docs: DataFrame, now, before, longest: int) -> DataFrame:
    """``key, info, n`` of the proposal and its border; without ``before``, all words and (size 0) the words of each language.

    With ``before``, of what ``now`` opens and ``before`` did not; a run opened here counts as a part at once, so the
    extensions of whatever turns out frequent are counted in the same pass.
    """

    def start():
        def work(words: Words, _: list[str]) -> Iterator[pa.RecordBatch]:
            found = {} if before is not None else {1: slice(None)}
            new = bloom.holds(now.value, words.run(1))
            old = bloom.holds(before.value, words.run(1)) if before is not None else None
            for size in range(2, longest + 1):
                own = _opened(words, size, new)
                new = bloom.holds(now.value, words.run(size))
                if before is not None:
                    own &= ~_opened(words, size, old)
                    old = bloom.holds(before.value, words.run(size))
                    new |= own
                found[size] = own
            yield _counted(words, found)
            if before is None:
                yield _languages(words)

        return work

    return _summed(_steps(docs, start, COUNTS))


def frequent(docs: DataFrame, least: int, longest: int, sample: float, seed: int, filter_blocks: int) -> DataFrame:
    """``key, info, n`` of all phrases that occur ``least`` times or more (size 0: the words of a language).

    The second pass leaves nothing open: a phrase that neither pass counted has a part that was counted and is not frequent.
    """
    taken = cut(docs.select("text", "lang").sample(False, sample, seed), "sample")
    keys = cut(proposed(taken, max(2, int(least * sample * LOWERED)), longest, filter_blocks), "proposal")
    bits = _filter(docs, keys, filter_blocks)
    found = cut(counted(docs, bits, None, longest).filter((F.col("n") >= least) | (size_of() == 0)), "frequent")
    failed = cut(found.filter(size_of() > 0).join(keys, "key", "left_anti").select("key"), "failures")
    if not failed.head(1):
        return found
    more = counted(docs, _joined(docs, bits, failed), bits, longest).filter(F.col("n") >= least)
    return found.unionByName(cut(more, "frequent"))


def _joined(docs: DataFrame, bits, keys: DataFrame):
    """The filter with further keys; it keeps its size, so it holds all it held."""
    size = len(bits.value)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        block, mask = bloom.spots(batch.column(0).to_numpy().view(np.uint64), size)
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], names=["block", "mask"])

    more = C.per_batch(keys, work, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    new = bits.value.copy()
    new[more.column(0).to_numpy()] |= more.column(1).to_numpy().view(np.uint64)
    return docs.sparkSession.sparkContext.broadcast(new)


def _owned(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys of (phrase, text)."""
    with np.errstate(over="ignore"):
        return C.mix(keys ^ (places * np.uint64(0xD1342543DE82EF95)))


def spelled(docs: DataFrame, phrases: DataFrame, longest: int, filter_blocks: int) -> DataFrame:
    """``key, language, lang, size, phrase, heads, tails`` of each phrase: its words, and the keys of its first and last words by cut.

    Only the text named by ``info`` (and its copies) spells a phrase out, so rows grow with the phrases and not with the tasks.
    """

    def owned(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, info = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(_owned(key, info >> np.uint64(SIZE_BITS)).view(np.int64))], names=["key"])

    shared = _filter(docs, phrases, filter_blocks)
    places = _filter(docs, C.per_batch(phrases.select("key", "info"), owned, "key long"), filter_blocks)

    def start():
        def work(words: Words, names: list[str]) -> Iterator[pa.RecordBatch]:
            for size in range(2, longest + 1):
                key = words.run(size)
                at = np.flatnonzero(words.whole(size))
                at = at[bloom.holds(shared.value, key[at])]
                at = at[bloom.holds(places.value, _owned(key[at], words.places[words.text[at]]))]
                at = at[np.unique(key[at], return_index=True)[1]]
                if not len(at):
                    continue
                parts = [np.stack([words.run(k)[at] for k in range(1, size)], 1), np.stack([words.run(size - k)[at + k] for k in range(1, size)], 1)]
                ends = np.arange(len(at) + 1, dtype=np.int32) * (size - 1)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(p.reshape(-1).view(np.int64))) for p in parts]
                text = [gathered(words.data, words.starts[at + k], words.ends[at + k]).to_pylist() for k in range(size)]
                own = words.text[at]
                yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(words.language[own].view(np.int64)), pa.array([names[t] for t in own], pa.string()),
                                                  pa.array(np.full(len(at), size, np.int32)), pa.array([" ".join(t) for t in zip(*text)], pa.string()), *lists],
                                                 names=["key", "language", "lang", "size", "phrase", "heads", "tails"])

        return work

    rows = _steps(docs, start, "key long, language long, lang string, size int, phrase string, heads array<long>, tails array<long>")
    return rows.join(phrases.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _wide(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(phrases: DataFrame, found: DataFrame, scale: int = 1000) -> DataFrame:
    """``key, lang, size, phrase, a, n, l, r, score`` of the frequent phrases: the lowest ``floor(scale * a * n / (l * r))`` of all cuts, the first of equal ones.

    Products have up to 38 digits and the division is one of whole numbers.
    """
    counts = found.select(F.col("key").alias("part"), F.col("n").alias("count"))
    cuts = phrases.select("key", "a", "n", F.posexplode(F.arrays_zip("heads", "tails")).alias("k", "cut")).select("key", "a", "n", "k", F.col("cut.heads").alias("head"), F.col("cut.tails").alias("tail"))
    cuts = cuts.join(counts.withColumnRenamed("part", "head").withColumnRenamed("count", "l"), "head").join(counts.withColumnRenamed("part", "tail").withColumnRenamed("count", "r"), "tail")
    product = (F.lit(scale).cast("decimal(6,0)") * (_wide("a") * _wide("n")).cast("decimal(32,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumn("product", product).withColumn("parts", (_wide("l") * _wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("product div parts"))
    lowest = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return phrases.join(lowest, "key").select("key", "lang", "size", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def covered(phrases: DataFrame, percent: int) -> DataFrame:
    """Keys of phrases inside a longer one with at least ``percent`` of their occurrences.

    Looking one word further is enough: what lies between a phrase and such a longer one occurs as often at least.
    """
    inner = phrases.filter("size > 2").select(F.explode(F.array(F.element_at("heads", -1), F.element_at("tails", 1))).alias("key"), F.col("a").alias("longer"))
    best = inner.groupBy("key").agg(F.max("longer").alias("longer"))
    return phrases.select("key", "a").join(best, "key").filter(F.col("longer") * 100 >= F.col("a") * percent).select("key")


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, cover_percent: int = 100, first: int | None = 2000, sample: float = SAMPLE, seed: int = 7, filter_blocks: int = bloom.LIMIT) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``text`` and ``lang``; other columns are ignored and repeated rows count each time.  A null language is ``und``, a
    null or empty text has no words.  Words are lower-cased within A-Z and split at blanks and tabs; phrases do not cross
    ``.,;:!?`` or line ends.  Ranks go by score, then count, both descending, then phrase in byte order; ``first`` is the length of the report
    (None: all phrases).  An empty table, or one without a frequent phrase, gives an empty result.  ``sample`` steers the
    work only.
    """
    if not 2 <= longest < 1 << SIZE_BITS:
        raise ValueError("phrases have 2 to 15 words")
    found = cut(frequent(docs, min_count, longest, sample, seed, filter_blocks), "phrases")
    words = spelled(docs, found.filter(size_of() > 1), longest, filter_blocks)
    counts = found.filter(size_of() > 1).select("key", F.col("n").alias("a"))
    totals = found.filter(size_of() == 0).select(F.col("key").alias("language"), "n")
    phrases = cut(words.join(counts, "key").join(totals, "language"), "spelled")
    kept = scored(phrases, found.filter(size_of() > 0)).join(covered(phrases, cover_percent), "key", "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if first is None else ranked.filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
