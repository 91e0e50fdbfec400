"""Byte-level BPE encoding and decoding; each distinct pre-token of the corpus is merged once.

Texts pass in blocks.  A block keeps its texts as lists of pre-token numbers and deals its distinct pre-tokens to shards by hash.  A
shard merges the lists of all blocks; Spark folds the ranked merges over the byte arrays of its distinct pre-tokens with
higher-order functions; the shard answers each block's list in the list's own order.  A block then puts its answers together
and gives its texts their ids.  Lists, answers and numbers are packed columns, there are as many shards as input partitions, and no
task holds more than one shard or one group of ``TOGETHER`` blocks.  Texts are written once, bucketed by their group, and never cross
a shuffle: only lists and answers do.

The rank map is a literal: ``buckets[hash(left, right)]`` holds a small map from the pair to the id that it
merges to.  The id of a merge is its rank, so the fold takes the lowest one, leftmost first, until none is
left.  Folding is quadratic in a pre-token's length; those over ``LONG`` bytes are merged by the same
rule with a heap before they are sent.

Splitting runs on distinct stretches too: a text is cut before each blank between two characters that are not white space, where the
pattern must begin a new match and look neither back nor beyond (true of patterns whose only use of a blank is to precede a word).
Stretches and pre-tokens are told apart by 64-bit hashes within a block or shard.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C

#: Bytes of text whose distinct pre-tokens are listed together.
BLOCK = 8 << 20
#: Blocks of one task that are put together as one group.
TOGETHER = 4
LONG = 128
NONE = 2**31 - 1
SLOTS = 1 << 17
#: Pre-tokens of one row batch.
WIDTH = 16384


def read_ranks(definition: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in definition.splitlines() if line.strip())}


def _slot(left: int, right: int) -> int:
    return (left * 8191 + right) % SLOTS


def rank_map(docs: DataFrame, ranks: dict[bytes, int]) -> Column:
    """The literal: an array of maps from ``left << 32 | right`` to the merged id (bounded by the vocabulary)."""
    buckets: list[dict[int, int]] = [{} for _ in range(SLOTS)]
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                buckets[_slot(left, right)][left << 32 | right] = rank
    at = np.append(0, np.cumsum([len(b) for b in buckets])).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(at), pa.array([k for b in buckets for k in b], pa.int64()), pa.array([v for b in buckets for v in b.values()], pa.int32()))
    held = pa.table({"buckets": pa.ListArray.from_arrays(pa.array([0, SLOTS], pa.int32()), maps)})
    return C.constant(docs.sparkSession.createDataFrame(held))


def folded(ids: Column, buckets: Column) -> Column:
    """The ids left when every merge that applies has been made; ``ids`` has one id, or several between -1 and -1."""

    def merged(left: Column, right: Column) -> Column:
        key = F.shiftleft(left.cast("long"), 32) + right.cast("long")
        return F.coalesce(F.try_element_at(F.get(buckets, (left * 8191 + right) % SLOTS), key), F.lit(NONE))

    def step(state: Column, _: Column) -> Column:
        old, ranks = state["ids"], state["ranks"]

        def joined(m: Column, p: Column) -> Column:
            new = F.concat(F.slice(old, F.lit(1), p - 1), F.array(m), F.slice(old, p + 2, F.size(old)))
            beside = F.array(merged(F.get(old, p - 2), m), merged(m, F.get(old, p + 1)))
            return F.struct(new.alias("ids"), F.concat(F.slice(ranks, F.lit(1), p - 2), beside, F.slice(ranks, p + 2, F.size(old))).alias("ranks"))

        # a transform over an array of one binds a value that is used several times
        at = lambda m: F.get(F.transform(F.array(F.array_position(ranks, m).cast("int")), lambda p: joined(m, p)), F.lit(0))
        return F.get(F.transform(F.array(F.array_min(ranks)), lambda m: F.when(m < NONE, at(m)).otherwise(state)), F.lit(0))

    # -1 at both ends pairs with nothing, so every merge has two neighbours
    pairs = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda i: merged(F.get(ids, i - 1), F.get(ids, i)))
    start = F.struct(ids.alias("ids"), pairs.alias("ranks"))
    inner = lambda s: F.slice(s["ids"], F.lit(2), F.size(s["ids"]) - 2)
    return F.when(F.size(ids) < 2, ids).otherwise(F.aggregate(F.sequence(F.lit(4), F.size(ids)), start, step, inner))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long pre-token, in ``n log n``."""
    parts: list[bytes | None] = [bytes([b]) for b in word]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[word[i:i + 2]], i, word[i:i + 2]) for i in range(len(word) - 1) if word[i:i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, text = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != text:
            continue
        parts[i], parts[j] = text, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < len(parts):
                both = parts[left] + parts[after[left]]
                if both in ranks:
                    heapq.heappush(heap, (ranks[both], left, both))
    return [ranks[p] for p in parts if p is not None]


def squeezed(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(array.tobytes(), 4)


def opened(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data, max_output_size=1 << 31), kind)


def halves(array: np.ndarray) -> bytes:
    """32-bit numbers as two packed planes of 16 bits, which take less room."""
    low = squeezed((array & 0xFFFF).astype(np.uint16))
    return len(low).to_bytes(8, "little") + low + squeezed((array >> 16).astype(np.uint16))


def joined(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return opened(data[8:end], np.uint16).astype(np.int32) | opened(data[end:], np.uint16).astype(np.int32) << 16


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of every text, and how many precede each text.

    A stretch begins at a text's start and at each blank between characters that cannot be white space (three-byte characters that
    might be, and no-break spaces, count as such).
    """
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > 2:
        lead = data[2:]
        inner = (data[1:-1] == 0x20) & (data[:-2] > 0x20) & (lead > 0x20) & ~np.isin(lead, (0xC2, 0xE1, 0xE2, 0xE3))
        inner[1:] &= data[:-3] != 0xC2
        inner[2:] &= ~np.isin(data[:-4], (0xE1, 0xE2, 0xE3))
        begin[1:n - 1] = inner
        # what lies beyond a text's ends is no neighbour
        edge = offsets[(offsets > 0) & (offsets < n)]
        begin[edge - 1] = False
    begin[offsets] = True
    begin[n] = False
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets)


class Block:
    """Pre-token numbers of the texts of a block, numbered as they first occur."""

    def __init__(self, find) -> None:
        self.find = find
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.slots: dict[int, int] = {}
        self.parts: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.keys: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: list[int | None], data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, before = stretches(data, offsets)
        hashes, spot, back = np.unique(C.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        names = hashes.tolist()
        new = [k for k, name in enumerate(names) if name not in self.slots]
        raw = data.tobytes()
        found = [[self.number[w] for w in self.find(raw[starts[i]:ends[i]].decode("utf-8", "replace"))] for i in spot[new].tolist()]
        self.slots.update(zip((names[k] for k in new), range(len(self.slots), len(self.slots) + len(new))))
        more = np.array([len(f) for f in found], np.int64)
        self.first = np.append(self.first, self.first[-1] + np.cumsum(more))
        self.flat = np.append(self.flat, np.fromiter((x for f in found for x in f), np.int32, int(more.sum())))
        slot = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[back]
        size = self.first[slot + 1] - self.first[slot]
        stop = np.append(0, np.cumsum(size))
        self.texts.append(self.flat[np.arange(stop[-1]) + np.repeat(self.first[slot] - stop[:-1], size)])
        self.length.append(np.diff(stop[before]))
        self.keys += keys
        self.size += len(data)

    def rows(self, home: int, block: int, shards: int) -> Iterator[tuple]:
        """``home, block, shard, ids, lengths, shards, body``: the texts and each word's shard (shard -1), then each shard's list of words."""
        raw = [w.encode() for w in self.number]
        size = np.array([len(r) for r in raw], np.int64)
        stop = np.append(0, np.cumsum(size))
        data = np.frombuffer(b"".join(raw), np.uint8)
        with np.errstate(over="ignore"):
            shard = (C.mix(C.word_hashes(data, stop[:-1], stop[1:])) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ids = np.array([0 if k is None else k for k in self.keys], np.int64)
        null = np.array([k is None for k in self.keys], np.uint8)
        numbers = np.concatenate([np.zeros(0, np.int32), *self.texts])
        yield home, block, -1, ids.tobytes() + null.tobytes(), squeezed(np.concatenate([np.zeros(0, np.int64), *self.length])), halves(shard.astype(np.int32)), halves(numbers)
        for s in np.unique(shard):
            own = order[shard[order] == s]
            yield home, block, int(s), None, squeezed(size[own].astype(np.int32)), None, squeezed(np.frombuffer(b"".join([raw[k] for k in own]), np.uint8))


def _start_ids(words: list[bytes], known: dict[bytes, int], of_byte: np.ndarray) -> pa.Array:
    """Ids of the bytes of each word between -1 and -1; words of the vocabulary and long ones are done already."""
    done = {k: [known[r]] if r in known else [-1, *heap_merge(r, known), -1] for k, r in enumerate(words) if r in known or len(r) > LONG}
    length = np.array([len(done[k]) if k in done else len(r) + 2 for k, r in enumerate(words)])
    stops = np.append(0, np.cumsum(length)).astype(np.int32)
    out = np.full(stops[-1], -1, np.int32)
    plain = np.ones(len(words), bool)
    plain[list(done)] = False
    size = length[plain] - 2
    begin = stops[:-1][plain] + 1
    inside = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    out[inside] = of_byte[np.frombuffer(b"".join(r for r, p in zip(words, plain) if p), np.uint8)]
    for k, found in done.items():
        out[stops[k]:stops[k + 1]] = found
    # between finished ids the fold finds nothing to merge
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(out))


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches by runs of equal values of one column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _ragged(flat: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked lists end to end, and their lengths."""
    size = first[pick + 1] - first[pick]
    stop = np.append(0, np.cumsum(size))
    return flat[np.arange(stop[-1]) + np.repeat(first[pick] - stop[:-1], size)], size


def _merged(lists: DataFrame, docs: DataFrame, ranks: dict[bytes, int], shared, shards: int) -> DataFrame:
    """``home, block, shard, lengths, body``: the ids of every word of every list, in the list's order."""

    def words_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per shard its number of distinct words, these as byte ids, then each block's list as numbers of them."""
        known = shared.value
        of_byte = np.array([known.get(bytes([b]), -1) for b in range(256)], np.int32)

        def row(home: int | None, block: int | None, shard: int, units: pa.Array | None, picks: bytes | None, n: int = 1) -> pa.RecordBatch:
            units = pa.nulls(n, pa.list_(pa.int32())) if units is None else units
            columns = [pa.array([home] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array([shard] * n, pa.int32()), units, pa.array([picks] * n, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["home", "block", "shard", "bytes", "picks"])

        for rows in _grouped(batches, 2):
            shard, sizes = rows[0][2], [opened(r[3], np.int32) for r in rows]
            size = np.concatenate(sizes).astype(np.int64)
            data = np.concatenate([opened(r[4], np.uint8) for r in rows])
            stop = np.append(0, np.cumsum(size))
            with np.errstate(over="ignore"):
                _, spot, back = np.unique(C.word_hashes(data, stop[:-1], stop[1:]), return_index=True, return_inverse=True)
            raw, begin, end = data.tobytes(), stop[spot].tolist(), stop[spot + 1].tolist()
            yield row(None, len(begin), shard, None, None)
            for at in range(0, len(begin), WIDTH):
                part = [raw[a:b] for a, b in zip(begin[at:at + WIDTH], end[at:at + WIDTH])]
                yield row(None, None, shard, _start_ids(part, known, of_byte), None, len(part))
            at = 0
            for r, own in zip(rows, sizes):
                yield row(r[0], r[1], shard, None, squeezed(back[at:at + len(own)].astype(np.int32)))
                at += len(own)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, parts, flat, first = 0, [], np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if left:
                    units = batch.column(3).slice(at, min(left, batch.num_rows - at))
                    parts.append((units.flatten().to_numpy(), np.diff(units.offsets.to_numpy())))
                    left -= len(units)
                    at += len(units)
                    if not left:
                        flat = np.concatenate([p[0] for p in parts])
                        first = np.append(0, np.cumsum(np.concatenate([p[1] for p in parts])))
                        parts = []
                elif not batch.column(4)[at].is_valid:
                    left = batch.column(1)[at].as_py()
                    at += 1
                else:
                    ids, size = _ragged(flat, first, opened(batch.column(4)[at].as_py(), np.int32))
                    own = [*(batch.column(k).slice(at, 1) for k in range(3)), pa.array([halves(size.astype(np.int32))]), pa.array([halves(ids.astype(np.int32))])]
                    yield pa.RecordBatch.from_arrays(own, names=["home", "block", "shard", "lengths", "body"])
                    at += 1

    dealt = lists.select("home", "block", "shard", "lengths", "body").repartition(shards, "shard").sortWithinPartitions("shard", "block")
    mixed = dealt.mapInArrow(words_first, "home long, block long, shard int, bytes array<int>, picks binary")
    merged = mixed.select("home", "block", "shard", F.when(F.col("bytes").isNotNull(), folded(F.col("bytes"), rank_map(docs, ranks))).alias("bytes"), "picks")
    return merged.mapInArrow(answered, "home long, block long, shard int, lengths binary, body binary")


def encode(docs: DataFrame, definition: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every text (and the ids as little-endian 32-bit ``ids``).

    A null text is empty: no tokens, and the digests of nothing.  Rows are kept one for one, with null and repeated ids as they are; other
    columns are not read.  An empty table gives an empty result.
    """
    ranks = read_ranks(definition)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    shards = max(rows.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, made = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        block = Block(find)

        def done() -> Iterator[pa.RecordBatch]:
            home = (made >> 32 << 32) + (made & 0xFFFFFFFF) // TOGETHER
            for row in block.rows(home, made, shards):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4))], names=["home", "block", "shard", "ids", "lengths", "shards", "body"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, end, data, offsets in C.text_steps(batch, "text"):
                with np.errstate(over="ignore"):
                    block.add(keys[at:end], data, offsets)
                if block.size > BLOCK:
                    yield from done()
                    block, made = Block(find), made + 1
        if block.keys:
            yield from done()
        block = None
        C.released()

    def join(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of a group of blocks: each block's texts with the answers to its lists."""
        pieces = {rank: token for token, rank in shared.value.items()}
        figures = [str(k) for k in range(max(pieces, default=0) + 1)]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        found = []
        answers = answers.sort_by([("block", "ascending"), ("shard", "ascending")])
        for row in range(texts.num_rows):
            own = answers.filter(pc.equal(answers["block"], texts["block"][row]))
            # lists follow each other by shard, each in the order of its numbers
            order = np.argsort(joined(texts["shards"][row].as_py()), kind="stable")
            flat = np.concatenate([np.zeros(0, np.int32), *(joined(v.as_py()) for v in own["body"])]).tolist()
            size = np.concatenate([np.zeros(0, np.int32), *(joined(v.as_py()) for v in own["lengths"])])
            stop = np.append(0, np.cumsum(size)).tolist()
            digits, decoded, counts = np.empty(len(order), object), np.empty(len(order), object), np.empty(len(order), np.int64)
            counts[order] = size
            for k, a, b in zip(order.tolist(), stop[:-1], stop[1:]):
                part = flat[a:b]
                digits[k] = " ".join([figures[x] for x in part])
                decoded[k] = b"".join([pieces[x] for x in part])
            length, keys = opened(texts["lengths"][row].as_py(), np.int64), texts["ids"][row].as_py()
            n, numbers = len(length), joined(texts["body"][row].as_py())
            own_ids, null = np.frombuffer(keys, np.int64, n), np.frombuffer(keys, np.uint8, n, 8 * n)
            at, out = 0, []
            for k in range(n):
                used = numbers[at:at + length[k]]
                at += length[k]
                line = " ".join(digits[used])
                value = (None if null[k] else int(own_ids[k]), int(counts[used].sum()), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(b"".join(decoded[used])).hexdigest())
                out.append((*value, np.array(line.split(), "<u4").tobytes()) if ids else value)
            found.append(pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names))
        del answers, digits, decoded, flat
        C.released()
        return pa.concat_tables(found)

    kept = C.bounded(rows).mapInArrow(split, "home long, block long, shard int, ids binary, lengths binary, shards binary, body binary")
    packed = C.bucketed(kept, "home", shards, "pretokens")
    answers = _merged(packed.filter("shard >= 0"), docs, ranks, shared, shards)
    both = packed.filter("shard < 0").groupBy("home").cogroup(answers.groupBy("home"))
    return both.applyInArrow(join, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else ""))
