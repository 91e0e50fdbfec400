"""Packing of texts into fixed windows by non-negative least squares.

A text is its token ids and one end id.  Whole windows are cut off it; what remains (less than a window) is
counted in a histogram of ``BINS`` length classes.  All combinations of up to three classes that fill a
window are enumerated, repeat counts are solved by non-negative least squares against the histogram and
rounded down, and each planned sequence takes the next pieces of its classes.  The rest is packed greedily
end to end, cut at the window's edges; its last part is cut into powers of two, which need no padding.

Planning sees one histogram of fixed size.  Ranks within a class are counted per hashed part of the table,
so a class that holds most texts is not sorted in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mintweave.llm import common as C
from mintweave.session import cut

BINS = 256
#: Words whose ids a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Bytes of text whose units are looked up together.
STEP = 1 << 20
#: Words that are encoded in one call, and the mark between them.
TOGETHER = 256
MARK = "\x01"
PIECE = "id long, body long, start long, length long, ids_crc32 long, doc_tokens long"


#: 1: ASCII letters and digits, 2: other printable ASCII but the apostrophe.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[39] = 0


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, cut further where letters or digits meet marks: starts, ends, and units before each text."""
    starts, ends, first = C.word_spans(data, offsets)
    if not len(starts):
        return starts, ends, first
    kind = KIND[data]
    inner = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] * kind[:-1] == 2)) + 1
    # two texts may meet without a blank
    inner = inner[~np.isin(inner, offsets)]
    begin = np.sort(np.concatenate([starts, inner]))
    return begin, np.sort(np.concatenate([ends, inner])), np.searchsorted(begin, offsets)


_coders: dict[int, WordIds] = {}


def coder_of(definition: str) -> WordIds:
    """One tokenizer per worker process."""
    key = hash(definition)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordIds(definition)
    return _coders[key]


class WordIds:
    """Token ids of whole texts, each distinct unit encoded once.

    Right for tokenizers that lower-case, drop white space and never join letters, digits and marks, and whose special tokens
    take no blanks beside them, which the caller vouches for.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # special tokens are found in a text as it stands, before it is normalised; of two that begin together the longer one
        self.special = {token.content.encode(): number for number, token in self.tokenizer.get_added_tokens_decoder().items() if token.special}
        longest = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        # between them nothing is one
        self.tokenizer.encode_special_tokens = True
        # a word of its own between words, told by its one id; a tokenizer without such an id has words sent singly
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 and self.tokenizer.encode(f"a {MARK} {MARK} b", add_special_tokens=False).ids[1:3] == mark * 2 else None
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.first = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.filled = 0

    def forget(self) -> None:
        """Drop what is remembered: the worker lives on and may serve other stages."""
        self._clear()
        C.released()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        if self.mark is None or any(MARK in w for w in words):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((t for ids in found for t in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        lines = [f" {MARK} ".join(words[at:at + TOGETHER]) + f" {MARK}" for at in range(0, len(words), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def _add(self, words: list[str], keys: list[int]) -> None:
        ids, length = self._encoded(words)
        total = len(ids)
        if self.used + len(words) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(len(self.first) + len(words), np.int64)])
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + total, np.uint32)])
        self.first[self.used + 1:self.used + 1 + len(words)] = self.filled + np.cumsum(length)
        self.flat[self.filled:self.filled + total] = ids
        self.slots.update(zip(keys, range(self.used, self.used + len(words))))
        self.used += len(words)
        self.filled += total

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin; a special token in a text is its one id, as in the tokenizer's plain call."""
        raw = data.tobytes()
        texts = zip(offsets[:-1].tolist(), offsets[1:].tolist()) if self.marks and self.marks.search(raw) else ()
        spans = [m.span() for a, b in texts for m in self.marks.finditer(raw, a, b)]
        if not spans:
            return self._plain(data, offsets)
        starts = np.array([a for a, _ in spans], np.int64)
        data = data.copy()
        for a, b in spans:
            data[a:b] = 0x20
        edges = np.sort(np.concatenate([offsets, starts]))
        ids, first = self._plain(data, edges)
        ids = np.insert(ids, first[np.searchsorted(edges, starts)], [self.special[raw[a:b]] for a, b in spans])
        return ids, first[np.searchsorted(edges, offsets)] + np.searchsorted(starts, offsets)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches without special tokens, and where each one's begin."""
        data = C.LOWER[data]
        starts, ends, first = units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, spot, back = np.unique(C.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if self.used > REMEMBERED:
            self._clear()
        have = self.slots
        names = keys.tolist()
        new = [k for k, name in enumerate(names) if name not in have]
        if new:
            raw = data.tobytes()
            where = spot[new]
            self._add([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[where].tolist(), ends[where].tolist())], [names[k] for k in new])
        slot = np.fromiter(map(have.__getitem__, names), np.int64, len(names))
        begin, size = self.first[slot].astype(np.int32), (self.first[slot + 1] - self.first[slot]).astype(np.int32)
        size = size[back]
        stops = np.append(np.int32(0), np.cumsum(size, dtype=np.int32))
        ids = self.flat[np.repeat(begin[back] - stops[:-1], size) + np.arange(stops[-1], dtype=np.int32)]
        return ids, stops[first]


def measured(docs: DataFrame, definition: str, window: int, end_id: int) -> DataFrame:
    """Whole windows and remainder of every text, with the checksum of their ids."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows = []
            for at, end, data, offsets in C.text_steps(batch, "text", STEP):
                with np.errstate(over="ignore"):
                    ids, first = coder.encode(data, offsets)
                for i in range(end - at):
                    own = np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(keys[at + i], bodies[at + i], start, min(window, len(own) - start), zlib.crc32(own[start:start + window].tobytes()), len(own)) for start in range(0, len(own), window)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6, names=["id", "body", "start", "length", "ids_crc32", "doc_tokens"])
        coder.forget()

    return C.bounded(docs).mapInArrow(work, PIECE)


def recut(docs: DataFrame, pieces: DataFrame, definition: str, end_id: int) -> DataFrame:
    """``pieces`` (id, body, start, length and more) with the checksum of their ids, for pieces cut after measuring.

    A text is found by its id, which may be null, and the hash of its body.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    wanted = cut(pieces.groupBy("id", "body").agg(F.collect_set(F.struct("start", "length")).alias("cuts")), "cuts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared.value)
        for batch in batches:
            keys, bodies, cuts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = []
            for at, end, data, offsets in C.text_steps(batch, "text", STEP):
                with np.errstate(over="ignore"):
                    ids, first = coder.encode(data, offsets)
                for i in range(end - at):
                    own = np.append(ids[first[i]:first[i + 1]], np.uint32(end_id)).astype("<u4")
                    rows += [(keys[at + i], bodies[at + i], c["start"], c["length"], zlib.crc32(own[c["start"]:c["start"] + c["length"]].tobytes())) for c in cuts[at + i]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["id", "body", "start", "length", "ids_crc32"])
        coder.forget()

    some = C.likely(docs.filter("id is not null"), wanted.filter("id is not null").select("id"), "id")[0].unionByName(docs.filter("id is null"))
    asked = wanted.withColumnsRenamed({"id": "i", "body": "b"})
    texts = some.join(asked, (F.col("body") == F.col("b")) & F.col("id").eqNullSafe(F.col("i"))).select("id", "text", "body", "cuts")
    names = ["id", "body", "start", "length"]
    # equal rows have equal sums, of which one is enough
    sums = texts.mapInArrow(work, "id long, body long, start long, length long, ids_crc32 long").dropDuplicates(names).withColumnsRenamed({n: f"_{n}" for n in names})
    same = [F.col(n) == F.col(f"_{n}") for n in names[1:]]
    return pieces.drop("ids_crc32").join(sums, same[0] & same[1] & same[2] & F.col("id").eqNullSafe(F.col("_id"))).drop(*[f"_{n}" for n in names])


def combinations(bins: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Every non-increasing tuple of at most ``depth`` length classes with sum ``bins``."""
    out = [(bins,)]
    if depth > 1:
        out += [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    if depth > 2:
        out += [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return out


def least_squares(parts: list[tuple[int, ...]], goal: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Repeat counts ``x >= 0`` that bring the classes used nearest to ``goal`` (active-set method)."""
    design = np.zeros((len(goal), len(parts)))
    for j, part in enumerate(parts):
        for b in part:
            design[b - 1, j] += 1
    scale = max(goal.max(), 1)
    target = goal / scale
    x = np.zeros(len(parts))
    passive = np.zeros(len(parts), bool)
    for _ in range(rounds):
        slope = design.T @ (target - design @ x)
        slope[passive] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-9:
            break
        passive[best] = True
        while True:
            used = np.flatnonzero(passive)
            a = design[:, used]
            z = np.linalg.lstsq(a.T @ a + 1e-10 * np.eye(len(used)), a.T @ target, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[used] = z
                break
            bad = z <= 0
            step = np.min(x[used][bad] / np.maximum(x[used][bad] - z[bad], 1e-300))
            x[used] += step * (z - x[used])
            x[used[bad & (x[used] <= 1e-12)]] = 0
            passive &= x > 1e-12
            if not passive.any():
                break
    return x * scale


def plan(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Ranges of ranks per class: first key (class and rank), length, first sequence, slot; and the number of sequences."""
    parts = combinations(len(histogram))
    repeats = np.floor(least_squares(parts, histogram.astype(float)) + 1e-6).astype(np.int64)
    left, used = histogram.astype(np.int64).copy(), np.zeros(len(histogram), np.int64)
    ranges, sequence = [], 0
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        classes, times = np.unique(np.array(parts[j]), return_counts=True)
        n = int(min(repeats[j], (left[classes - 1] // times).min()))
        if n > 0:
            for slot, b in enumerate(parts[j]):
                ranges.append(((b << 44) + used[b - 1], n, sequence, slot))
                used[b - 1] += n
                left[b - 1] -= n
            sequence += n
    ranges.sort()
    columns = [np.array(c, np.int64) for c in zip(*ranges)] if ranges else [np.zeros(0, np.int64)] * 4
    return *columns, sequence


def placed(ranked: DataFrame, ranges: tuple[np.ndarray, ...]) -> DataFrame:
    """Adds ``sequence_id`` and ``slot`` (null for pieces that the plan leaves over) from ``class`` and ``rank``."""
    first, count, sequence, slot = ranges

    @F.pandas_udf("sequence_id long, slot long")
    def seat(kind, rank):
        import pandas as pd

        key = (kind.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        spot = np.searchsorted(first, key, "right") - 1
        ok = (spot >= 0) if len(first) else np.zeros(len(key), bool)
        spot = np.where(ok, spot, 0)
        if len(first):
            ok &= key - first[spot] < count[spot]
        value = (sequence[spot] + key - first[spot], slot[spot]) if len(first) else (key, key)
        return pd.DataFrame({n: pd.Series(np.where(ok, v, 0), dtype="Int64").mask(~ok) for n, v in zip(("sequence_id", "slot"), value)})

    return ranked.withColumn("seat", seat("class", "rank")).select("*", "seat.sequence_id", "seat.slot").drop("seat")


def pack(docs: DataFrame, definition: str, window: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    ``definition`` is the tokenizer's JSON text.  Ids may be null or repeat: each row is a text of its own, and texts that share an id
    have its pieces together.  A null text is empty: one end id.
    Every id lies in one piece; offsets of a sequence have no gap.  Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("body"))
    step = window // BINS
    pieces = cut(measured(rows, definition, window, end_id), "pieces")
    parts = max(16, pieces.rdd.getNumPartitions() * 4)
    kind = F.when(F.col("length") == window, BINS + 1).otherwise(F.ceil(F.col("length") / step).cast("long"))
    dealt = pieces.withColumn("class", kind.cast("long")).withColumn("part", F.pmod(F.xxhash64("id", "body", "start"), F.lit(parts)))
    counts = dealt.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "part").orderBy("id", "body", "start")) - 1
    ranked = dealt.withColumn("within", within).join(before, ["class", "part"]).withColumn("rank", F.col("within") + F.col("before"))

    sizes = {r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}
    *ranges, planned = plan(np.array([sizes.get(b, 0) for b in range(1, BINS + 1)]))
    full = sizes.get(BINS + 1, 0)
    seated = cut(placed(ranked, tuple(ranges)), "seats")
    keep = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    whole = seated.filter(F.col("class") == BINS + 1).withColumn("sequence_id", F.lit(planned) + F.col("rank")).select(*keep, F.lit(0).cast("long").alias("offset"))
    ahead = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = seated.filter("slot is not null").withColumn("offset", ahead).select(*keep, "offset")

    rest = seated.filter(f"slot is null and class <= {BINS}")
    lengths = {r[0]: r[1] for r in rest.groupBy("part").agg(F.sum("length")).collect()}
    begins = np.append(0, np.cumsum([lengths.get(p, 0) for p in range(parts)])).tolist()
    total = begins[-1]
    # the stream is cut at every window, and its last part at powers of two
    edges = [total // window * window]
    while edges[-1] < total:
        edges.append(edges[-1] + (1 << ((total - edges[-1]).bit_length() - 1)))
    at = F.get(F.array(*[F.lit(v).cast("long") for v in begins]), F.col("part").cast("int"))
    run = F.coalesce(F.sum("length").over(Window.partitionBy("part").orderBy("class", "id", "body", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stream = rest.withColumn("lo", at + run).withColumn("hi", F.col("lo") + F.col("length"))
    marks = F.array_union(
        F.transform(F.sequence(F.floor(F.col("lo") / window), F.floor((F.col("hi") - 1) / window)), lambda k: k * window),
        F.array(*[F.lit(e).cast("long") for e in edges]),
    )
    cuts = F.array_sort(F.filter(marks, lambda e: (e > F.col("lo")) & (e < F.col("hi"))))
    bounds = F.concat(F.array("lo"), cuts, F.array("hi"))
    spans = F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda k: F.struct(F.get(bounds, k).alias("x"), F.get(bounds, k + 1).alias("y")))
    tail = F.array(*[F.lit(e).cast("long") for e in edges])
    number = F.floor(F.least(F.col("s.x"), F.lit(edges[0])) / window) + F.size(F.filter(tail, lambda e: (e > edges[0]) & (e <= F.col("s.x"))))
    base = F.when(F.col("s.x") < edges[0], F.floor(F.col("s.x") / window) * window).otherwise(F.array_max(F.filter(tail, lambda e: e <= F.col("s.x"))))
    chopped = stream.withColumn("parts", F.size(cuts)).withColumn("s", F.explode(spans)).select(
        "id", "body", (F.col("start") + F.col("s.x") - F.col("lo")).alias("start"), (F.col("s.y") - F.col("s.x")).alias("length"), "ids_crc32", "doc_tokens",
        (F.lit(planned + full) + number).cast("long").alias("sequence_id"), (F.col("s.x") - base).cast("long").alias("offset"), "parts",
    )
    chopped = cut(chopped, "chopped")
    intact = chopped.filter("parts = 0").drop("parts", "body")
    again = recut(rows, chopped.filter("parts > 0").drop("parts"), definition, end_id)
    return filled.unionByName(whole).unionByName(intact).unionByName(again.select(*intact.columns))
