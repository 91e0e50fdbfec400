"""Spelling variants: words one edit apart, found by probing edits against Bloom filters.

A vocabulary word is near another if one inserted, deleted or replaced code point turns it into the other.  Every
such pair is reached once: from the longer word by a deletion, or from the word with the greater letter by a
replacement with a lesser one.  Tasks make these edits as numbers only (a polynomial hash changes by one term), probe them
against Bloom filters sharded by word length, and spell out the positives alone; these shuffle to the
vocabulary, whose exact join removes the false ones.

The filters are broadcast; their bound is a parameter (``filter_blocks``, 64 bits each, 32 MB by default), not the vocabulary.
A larger vocabulary only lets more false positives reach the join, so pass a larger bound there (about 3 bytes a word).
A word has at most some 180 near words per letter, so no key of the joins that follow is hot.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import bloom
from mintweave.llm import common as C
from mintweave.session import cut

#: Bytes of text of one vectorised step.
STEP = 2 << 20
#: Words of this length and more share one filter.
LONGEST = 31
#: Edits tried at once.
EDITS = 1 << 18

#: a-z and U+00C0 to U+00FF as Latin-1 bytes.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True

_CODES = np.random.default_rng(20250811).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, code points and text of every maximal run of ``[A-Za-z\\u00C0-\\u00FF]``."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    inside = _LETTER[data] | second
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside)[:-1] & ~edge[:-1]
    after = np.append(inside, False)[1:] & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    tails = np.append(0, np.cumsum(second))
    return starts, ends, ends - starts - (tails[ends] - tails[starts]), np.searchsorted(offsets, starts, "right") - 1


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from ``state`` (the CRC-32 of what precedes it)."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size, crc = starts[order], size[order], ~state[order].astype(np.uint32)
    long = int(np.searchsorted(-size, -64, "left"))
    for i in range(long):
        crc[i] = ~np.uint32(zlib.crc32(data[at[i]:at[i] + size[i]].tobytes(), int(~crc[i])))
    for k in range(int(size[long]) if long < len(size) else 0):
        own = slice(long, int(np.searchsorted(-size, -k, "left")))
        crc[own] = _CRC[(crc[own] ^ data[at[own] + k]) & 255] ^ (crc[own] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~crc
    return out


def gathered_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as binary values."""
    size = ends - starts
    stop = np.append(0, np.cumsum(size)).astype(np.int32)
    body = np.ascontiguousarray(data[np.arange(stop[-1]) + np.repeat(starts - stop[:-1], size)])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(stop), pa.py_buffer(body)])


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    return gathered_bytes(data, starts, ends).view(pa.string())


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct spans and how often each occurs."""
    hashes = C.word_hashes(data, starts, ends)
    order = np.argsort(hashes)
    first = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0)[: len(order)])
    one = order[first]
    return gathered(data, starts[one], ends[one]), np.diff(np.append(first, len(order)))


def corrupted(word: bytes, spot: int) -> bytes:
    """The word without its code point number ``spot``."""
    text = word.decode()
    return (text[:spot] + text[spot + 1:]).encode()


def occurrences(docs: DataFrame, drop_every: int, min_letters: int, key: str = "doc_id") -> DataFrame:
    """``word, n`` of each step of the texts: letter runs, some of them with one letter lost.

    A run loses its code point ``h % length`` where ``drop_every`` divides ``h``, the CRC-32 of ``<id>:<run>``
    (0: none does).  A null text has no words, a null id is written as nothing.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        heads = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in batch.column(0).to_pylist()], np.uint32)
        for at, _, data, offsets in C.text_steps(batch, "text", STEP):
            data = C.LOWER[data]
            starts, ends, letters, text = letter_runs(data, offsets)
            own = letters >= min_letters
            starts, ends, letters, text = starts[own], ends[own], letters[own], text[own]
            if drop_every and len(starts):
                h = crc32s(data, starts, ends, heads[at + text])
                lost = h % np.uint32(drop_every) == 0
                short = Counter(corrupted(data[a:b].tobytes(), int(x) % int(n)) for a, b, x, n in zip(starts[lost], ends[lost], h[lost], letters[lost]) if n > min_letters)
                starts, ends = starts[~lost], ends[~lost]
                if short:
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in short], pa.string()), pa.array(list(short.values()), pa.int64())], names=["word", "n"])
            if len(starts):
                words, n = distinct_spans(data, starts, ends)
                yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], names=["word", "n"])

    return C.per_batch(docs.select(key, "text"), work, "word string, n long")


def vocabulary(found: DataFrame, min_count: int) -> DataFrame:
    """``word, n`` with at least ``min_count`` occurrences."""
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _matrices(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and letters (Latin-1, one row per word) of the words of each length."""
    flat = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.array([len(w) for w in flat], np.int64)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for at in range(0, len(rows), max(1, EDITS // int(n))):
            part = rows[at:at + max(1, EDITS // int(n))]
            yield part, np.frombuffer(b"".join(flat[i] for i in part), np.uint8).reshape(len(part), n)


def _terms(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base by place, and each letter's term of the hash."""
    powers = np.full(letters.shape[1], _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return powers, _CODES[letters] * powers


def _shard(length: int) -> int:
    return min(length, LONGEST)


def hashed(words: DataFrame) -> DataFrame:
    """``shard, key`` of every word for the filters."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, letters in _matrices(batch.column(0)):
            with np.errstate(over="ignore"):
                key = _terms(letters)[1].sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), _shard(letters.shape[1]), np.int32)), pa.array(key.view(np.int64))], names=["shard", "key"])

    return C.per_batch(words.select("word"), work, "shard int, key long")


def edits(letters: np.ndarray, filters: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and spelled letters of the edits that pass the filters: deletions, replacements by lesser letters."""
    powers, terms = _terms(letters)
    n = letters.shape[1]
    upto = np.cumsum(terms, axis=1, dtype=np.uint64)
    whole = upto[:, -1:]
    bits = filters.get(_shard(n - 1))
    if bits is not None and n > 1:
        first = np.ones(letters.shape, bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, spot = np.nonzero(first)
        hit = bloom.holds(bits, ((upto - terms) + (whole - upto) * _INVERSE)[row, spot])
        row, spot = row[hit], spot[hit]
        rest = np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] >= spot[:, None])
        yield row, letters[row[:, None], rest]
    bits = filters.get(_shard(n))
    for letter in ALPHABET if bits is not None else ():
        row, spot = np.nonzero(letters > letter)
        hit = bloom.holds(bits, whole[row, 0] - terms[row, spot] + _CODES[letter] * powers[spot])
        row, spot = row[hit], spot[hit]
        if len(row):
            new = letters[row]
            new[np.arange(len(row)), spot] = letter
            yield row, new


def candidates(words: DataFrame, filter_blocks: int) -> DataFrame:
    """``word, n, edit``: every edit that a filter lets pass."""
    spark = words.sparkSession
    shared = {shard: spark.sparkContext.broadcast(bits) for shard, bits in bloom.build(hashed(words), filter_blocks).items()}

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        filters = {shard: bits.value for shard, bits in shared.items()}
        with np.errstate(over="ignore"):
            for rows, letters in _matrices(batch.column(0)):
                for row, new in edits(letters, filters):
                    own = pa.array(rows[row])
                    spelled = pa.array([x.tobytes().decode("latin-1") for x in new], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), spelled], names=["word", "n", "edit"])

    # Probing costs far more than the words' bytes tell, so the number of tasks is set here.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return C.per_batch(words.select("word", "n").repartition(tasks), work, "word string, n long, edit string")


def near_pairs(words: DataFrame, filter_blocks: int = bloom.LIMIT) -> DataFrame:
    """``a, a_n, b, b_n``: each pair of words one edit apart, once.  ``words`` has distinct words and is read repeatedly."""
    known = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = candidates(words, filter_blocks).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"))
    return found.join(known, "b").select("a", "a_n", "b", "b_n")


def variants(words: DataFrame, factor: int = 10, filter_blocks: int = bloom.LIMIT) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``.

    ``words`` has columns ``word`` (letters of ``ALPHABET`` only) and ``n``; other columns are ignored, words must be distinct.
    A word's form is its near word of largest ``n`` (ties: the smallest word by code points) where that is at least
    ``factor`` (above 1) times its own; ``root`` follows forms to the last.  Without one, form is null and root the word.
    An empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2, or forms could run in circles")
    words = cut(words.select("word", "n"), "vocabulary")
    pairs = cut(near_pairs(words, filter_blocks), "near-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word"), F.col("a_n").alias("own")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), "b")).alias("best"))
    big = -F.col("best.less") >= F.lit(factor) * F.col("own")
    best = cut(best.select("word", "n_near", F.when(big, F.col("best.b")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n")), "forms")
    joined = words.join(best, "word", "left").join(_roots(best), "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(best: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: pointers are doubled until none moves; counts grow along them, so few rounds do."""
    state = best.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut(state.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not state.filter("moved").head(1):
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, drop_every: int = 0, min_letters: int = 7, min_count: int = 2, factor: int = 10, filter_blocks: int = bloom.LIMIT, key: str = "doc_id") -> DataFrame:
    """Variants of the words of all texts (columns ``key``, ``text``; others are ignored).

    Words are runs of ``[A-Za-z\\u00C0-\\u00FF]``, lower-cased within A-Z, of at least ``min_letters`` code points and
    ``min_count`` occurrences.  Null and empty texts have none; repeated rows count each time; ids may be null or repeat.
    """
    return variants(vocabulary(occurrences(docs, drop_every, min_letters, key), min_count), factor, filter_blocks)
