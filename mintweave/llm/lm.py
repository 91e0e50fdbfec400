"""Language-model scoring with a hierarchical Pitman-Yor model.

Texts are lower-cased (ASCII), their words joined by one blank each and closed by an end symbol.  The model
predicts each byte from the ``ORDER`` bytes before it: the restaurant of a context sends one customer per
table to the restaurant of the context without its oldest byte, which all such contexts share, down to a
single root over a uniform base.  Seating is sampled by Gibbs sweeps; predictive probabilities are averaged
over the sweeps after the first ones.  A text's score is the sum of their logarithms, so its perplexity per
token is ``10 ** (-score / n_tokens)``.

Spark's part.  Texts are dealt to blocks of about ``BLOCK`` bytes.  A block lists its distinct grams and
words with their training counts as sorted arrays, one row per block and shard.  A shard (contexts by their
last two bytes, words by hash) merges the lists of all blocks, samples its restaurants, and answers every
block with one value per entry, in the order in which the block listed them.  Each block then scores its
texts with its own list only.  So no task holds the whole model, nothing of it is broadcast except the table of one-byte
contexts (256 x 256), and both the lists and the shards grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.session import cut

ORDER = 5
BLOCK = 12 << 20
STRENGTH = 0.5
#: Sweeps per job; the first ``BURN`` are not averaged.  Jobs before the last settle the one-byte contexts.
SWEEPS, BURN, ROUNDS = 7, 3, 2
END, BLANK = 10, 32
PACKED = "block int, ids binary, train binary, lengths binary, body binary"


def squeeze(array: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(array.tobytes(), 1)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data, max_output_size=1 << 31), kind)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the joined words with their blanks and end symbols, and each text's length."""
    starts, ends, first = C.word_spans(data, offsets)
    words = np.diff(first)
    size = ends - starts
    total = np.append(0, np.cumsum(size))
    length = total[first[1:]] - total[first[:-1]] + words + 1
    out = np.full(int(length.sum()), BLANK, np.uint8)
    source = np.flatnonzero(~C.SPACE[data])
    text = np.repeat(np.arange(len(words)), words)
    out[np.arange(len(source)) + np.repeat(np.arange(len(size)) + text, size)] = C.LOWER[data[source]]
    out[np.cumsum(length) - 1] = END
    return out, length


def packed(docs: DataFrame, blocks: int) -> DataFrame:
    """Compressed texts by block from ``id, text, train``; ``ids`` has all ids, then for each whether it is null."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
        block = batch.column(3).to_numpy(zero_copy_only=False)
        for at, end, data, offsets in C.text_steps(batch, "text", 1 << 20):
            body, length = normalised(data, offsets)
            stop = np.cumsum(length)
            rows = []
            for b in np.unique(block[at:end]):
                own = np.flatnonzero(block[at:end] == b)
                text = np.concatenate([body[stop[i] - length[i]:stop[i]] for i in own])
                rows.append((int(b), ids[at + own].tobytes() + null[at + own].tobytes(), train[at + own].tobytes(), length[own].tobytes(), squeeze(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 4])], names=["block", "ids", "train", "lengths", "body"])

    return C.per_batch(docs.select("id", "text", "train", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")), work, PACKED)


def grams(body: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every symbol its context and itself, packed into 48 bits; a text's start counts as end symbols."""
    spot = np.arange(len(body)) + np.repeat(ORDER * np.arange(1, len(length) + 1), length)
    padded = np.full(len(body) + ORDER * len(length), END, np.uint64)
    padded[spot] = body
    key = np.zeros(len(padded), np.uint64)
    for k in range(ORDER + 1):
        key[ORDER:] |= padded[k:len(padded) - ORDER + k] << np.uint64(8 * (ORDER - k))
    return key[spot]


def words(body: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and its text."""
    offsets = np.append(0, np.cumsum(length))
    starts, ends, first = C.word_spans(body, offsets)
    return C.word_hashes(body, starts, ends), np.repeat(np.arange(len(length)), np.diff(first))


def _steps(body: np.ndarray, length: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``limit`` bytes."""
    stop = np.cumsum(length)
    at = 0
    while at < len(length):
        begin = stop[at] - length[at]
        end = max(at + 1, int(np.searchsorted(stop, begin + limit, "right")))
        yield slice(at, end), body[begin:stop[end - 1]], length[at:end]
        at = end


def _tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally_flagged(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of under 63 bits and how many of each are training ones (a plain sort, no index)."""
    both = np.sort(keys << np.uint64(1) | train.astype(np.uint64))
    keys = both >> np.uint64(1)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat((both & np.uint64(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def listed(rows: DataFrame, shards: int) -> DataFrame:
    """``kind, shard, block, keys, counts, tokens``: what each block asks of each shard."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        parts: dict[str, list] = {"gram": [], "word": []}
        tokens = 0
        with np.errstate(over="ignore"):
            for one in frame.itertuples():
                train, length = np.frombuffer(one.train, np.uint8), np.frombuffer(one.lengths, np.int64)
                for part, body, own in _steps(unsqueeze(one.body, np.uint8), length):
                    parts["gram"].append(_tally_flagged(grams(body, own), np.repeat(train[part], own)))
                    hashes, text = words(body, own)
                    parts["word"].append(_tally_flagged(hashes >> np.uint64(1), train[part][text]))
                    tokens += int(train[part][text].sum()) + int(train[part].sum())
        out = []
        for kind, found in parts.items():
            keys, counts = _tally(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
            shard = shard_of(keys, kind, shards)
            for s in np.unique(shard):
                own = shard == s
                out.append((kind, int(s), int(frame["block"].iloc[0]), squeeze(np.diff(keys[own], prepend=np.uint64(0))), squeeze(counts[own].astype(np.int32)), tokens if kind == "word" and not len([o for o in out if o[0] == "word"]) else 0))
        if not any(o[0] == "word" for o in out):
            out.append(("word", 0, int(frame["block"].iloc[0]), squeeze(np.zeros(0, np.uint64)), squeeze(np.zeros(0, np.int32)), tokens))
        return pd.DataFrame(out, columns=["kind", "shard", "block", "keys", "counts", "tokens"])

    return rows.groupBy("block").applyInPandas(work, "kind string, shard int, block int, keys binary, counts binary, tokens long")


def shard_of(keys: np.ndarray, kind: str, shards: int) -> np.ndarray:
    mixed = C.mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) if kind == "gram" else C.mix(keys)
    return (mixed % np.uint64(shards)).astype(np.int64)


def seat(customers: np.ndarray, strength: np.ndarray, discount: float, parent: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Tables opened when the customers of each dish sit down one after another.

    ``strength`` is ``theta + discount * (tables of other dishes)``.  The first opens a table.  Up to the 24th they
    are seated singly, later ones in groups of an eighth of those seated, whose new tables are binomial.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        group = 1 if seated < 24 else seated // 8
        t = tables[live]
        new = (strength[live] + discount * t) * parent[live]
        chance = new / (new + np.maximum(seated - discount * t, 1e-9))
        coming = np.minimum(group, customers[live] - seated)
        tables[live] += (random.random(len(live)) < chance) if group == 1 else random.binomial(coming, chance)
        seated += group
        live = live[customers[live] > seated]
    return tables


class Restaurants:
    """The restaurants of one shard: levels ``ORDER`` down to ``low`` symbols of context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int) -> None:
        self.levels = []
        self.counts = counts
        width = ORDER if low > 1 else 1
        for d in range(width, low - 1, -1):
            kept = keys
            if d < width:
                kept, self.levels[-1]["to_parent"] = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            _, room = np.unique(kept >> np.uint64(8), return_inverse=True)
            self.levels.append({"keys": kept, "room": room, "rooms": int(room.max()) + 1 if len(room) else 0})
            keys = kept
        customers = self.counts
        for level in self.levels:
            level["tables"] = np.minimum(customers, 1)
            ones, twos = (customers == 1).sum(), (customers == 2).sum()
            level["discount"] = float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))
            level["customers"] = customers
            customers = self._sent(level)

    @staticmethod
    def _sent(level: dict) -> np.ndarray | None:
        """Customers that a level's tables send to the level above it."""
        return np.bincount(level["to_parent"], level["tables"]).astype(np.int64) if "to_parent" in level else None

    def sweep(self, base: np.ndarray, random: np.random.Generator) -> np.ndarray:
        """One Gibbs sweep; returns the predictive probabilities of the deepest level before it.

        ``base`` has the probability of each entry of the shallowest level under the level above it.
        """
        given = base
        for level, children in zip(reversed(self.levels), [*reversed(self.levels[:-1]), None]):
            level["given"] = given
            c, t, room = level["customers"], level["tables"], level["room"]
            level["total"] = np.bincount(room, t, level["rooms"])
            seats = np.bincount(room, c, level["rooms"])
            a = level["discount"]
            p = (np.maximum(c - a * t, 0) + (STRENGTH + a * level["total"][room]) * given) / (STRENGTH + seats[room])
            # each entry of the level below finds its own here
            given = p[children["to_parent"]] if children else p
        customers = self.counts
        for level in self.levels:
            level["customers"] = customers
            others = level["total"][level["room"]] - level["tables"]
            level["tables"] = seat(customers, STRENGTH + level["discount"] * others, level["discount"], level["given"], random)
            customers = self._sent(level)
        return given


def _merged(frame: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The key list of every row, all distinct keys, and their counts over all rows."""
    lists = [np.cumsum(unsqueeze(k, np.uint64), dtype=np.uint64) for k in frame["keys"]]
    keys, counts = _tally(np.concatenate(lists), np.concatenate([unsqueeze(c, np.int32) for c in frame["counts"]]).astype(np.int64))
    return lists, keys, counts


def one_byte_contexts(messages: np.ndarray) -> np.ndarray:
    """Probability of each symbol after each single byte (256 x 256), from customers sent to these contexts."""
    random = np.random.default_rng(1)
    keys = np.flatnonzero(np.ones(256 * 256)).astype(np.uint64)
    rooms = Restaurants(keys, messages.ravel().astype(np.int64), 1)
    root_keys, up = np.arange(256), (keys & np.uint64(255)).astype(np.int64)
    total = np.zeros(256 * 256)
    for turn in range(SWEEPS):
        level = rooms.levels[0]
        customers = np.bincount(up, level["tables"], 256)
        root = (customers + STRENGTH / 256) / (customers.sum() + STRENGTH)
        p = rooms.sweep(root[root_keys][up], random)
        total += p if turn >= BURN else 0
    return (total / (SWEEPS - BURN)).reshape(256, 256)


def answers(lists: DataFrame, above: np.ndarray, last: bool) -> DataFrame:
    """Log10 probabilities for every list of grams (``last``), or the customers sent to the one-byte contexts."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        asked, keys, counts = _merged(frame)
        shard = int(frame["shard"].iloc[0])
        random = np.random.default_rng(shard + 7)
        rooms = Restaurants(keys, counts, 2)
        low = rooms.levels[-1]
        before, symbol = ((low["keys"] >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (low["keys"] & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(keys))
        for turn in range(SWEEPS):
            p = rooms.sweep(above[before, symbol], random)
            total += p if turn >= BURN else 0
        if not last:
            sent = np.bincount(before * 256 + symbol, low["tables"], 256 * 256).astype(np.int64)
            some = np.flatnonzero(sent)
            return pd.DataFrame({"shard": shard, "block": -1, "cell": some, "n": sent[some], "keys": None, "values": None})
        value = np.log10(total / (SWEEPS - BURN)).astype(np.float32)
        return pd.DataFrame({"shard": shard, "block": frame["block"], "cell": 0, "n": 0, "keys": frame["keys"], "values": [squeeze(value[np.searchsorted(keys, a)]) for a in asked]})

    return lists.groupBy("shard").applyInPandas(work, "shard int, block int, cell long, n long, keys binary, values binary")


def word_counts(lists: DataFrame) -> DataFrame:
    """Training counts for every list of words, and in ``n`` the shard's distinct training words (first row of a shard)."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        asked, keys, counts = _merged(frame)
        known = [int((counts > 0).sum())] + [0] * (len(frame) - 1)
        return pd.DataFrame({"shard": frame["shard"], "block": frame["block"], "n": known, "keys": frame["keys"], "values": [squeeze(counts[np.searchsorted(keys, a)].astype(np.int32)) for a in asked]})

    return lists.groupBy("shard").applyInPandas(work, "shard int, block int, n long, keys binary, values binary")


def scored(docs: DataFrame, train: str = "train", key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """``id, n_tokens, n_known, train_tokens, base_score, score`` of every text, learned from rows where ``train`` is true.

    A null or empty text is its end token alone.  With no training row the base and the model are uniform.
    A null ``train`` counts as false.  Rows are kept one for one, with null ids as they are, and repeated rows get equal results; other
    columns are not read.  Words are known by a 63-bit hash.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train"))
    size, trained = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0))).first()
    blocks = max(6, -(-size // block_bytes))
    shards = max(16, 2 * blocks)
    texts = packed(rows, blocks)
    lists = cut(listed(texts, shards), "lists")
    gram_lists = lists.filter("kind = 'gram'")
    known = cut(word_counts(lists.filter("kind = 'word'")), "words")
    distinct = (known.agg(F.sum("n")).first()[0] or 0) + (1 if trained else 0)
    tokens = lists.agg(F.sum("tokens")).first()[0] or 0
    above = np.full((256, 256), 1 / 256)
    for _ in range(ROUNDS):
        sent = np.zeros(256 * 256)
        for cell, n in answers(gram_lists, above, False).groupBy("cell").agg(F.sum("n")).collect():
            sent[cell] = n
        above = one_byte_contexts(sent)
    values = cut(answers(gram_lists, above, True).select("block", F.lit("gram").alias("kind"), "keys", "values").unionByName(known.select("block", F.lit("word").alias("kind"), "keys", "values")), "values")

    def work(body: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        table = {}
        for kind, width in (("gram", np.float32), ("word", np.int32)):
            own = model[model["kind"] == kind]
            keys = [np.cumsum(unsqueeze(k, np.uint64), dtype=np.uint64) for k in own["keys"]] or [np.zeros(0, np.uint64)]
            found = [unsqueeze(v, width) for v in own["values"]] or [np.zeros(0, width)]
            keys, found = np.concatenate(keys), np.concatenate(found)
            order = np.argsort(keys, kind="stable")
            table[kind] = keys[order], found[order].astype(np.float64)
        out = []
        with np.errstate(over="ignore"):
            for one in body.itertuples():
                length = np.frombuffer(one.lengths, np.int64)
                ids, null = np.frombuffer(one.ids, np.int64, len(length)), np.frombuffer(one.ids, np.uint8, len(length), 8 * len(length))
                for part, text_, own in _steps(unsqueeze(one.body, np.uint8), length):
                    keys, value = table["gram"]
                    score = np.add.reduceat(value[np.searchsorted(keys, grams(text_, own))], np.append(0, np.cumsum(own)[:-1]))
                    hashes, text = words(text_, own)
                    keys, value = table["word"]
                    count = value[np.searchsorted(keys, hashes >> np.uint64(1))] if len(hashes) else np.zeros(0)
                    share = lambda c: np.log10((c + 1) / (tokens + distinct + 1))
                    base = np.bincount(text, share(count), len(own)) + share(trained)
                    out.append((ids[part], null[part], np.bincount(text, minlength=len(own)) + 1, np.bincount(text, count > 0, len(own)).astype(np.int64) + (1 if trained else 0), base, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 6
        columns[0] = pd.array(columns[0].astype(np.int64), "Int64")
        columns[0][columns.pop(1).astype(bool)] = pd.NA
        return pd.DataFrame(dict(zip(("id", "n_tokens", "n_known", "base_score", "score"), columns)))

    result = texts.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(work, "id long, n_tokens long, n_known long, base_score double, score double")
    return result.select("id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
