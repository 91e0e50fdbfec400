"""Near-duplicate documents by HyperMinHash.

Each text becomes the set of its distinct five-word shingles (ASCII letters lower-cased).  A sketch has
``REGISTERS`` registers; each keeps the smallest hash it saw, compressed to its leading-zero count and
``MANTISSA`` bits.  Sets of up to ``WIDE`` shingles hash every shingle once per register; larger sets deal
their shingles to the registers.  Sets between the two limits have both sketches, so two sets of
similarity 0.75 always share a kind.  Bands of equal registers name candidates, the collision-corrected
estimate discards hopeless ones, and whole shingle sets confirm the rest.

Texts with equal sets are one class (128-bit set sum and size), so copies are never paired.  Within a
bucket, classes are first paired with its lowest one.  Where that leaves a bucket in several components, the
classes of all buckets that hang together are compared whole against whole, tile by tile, by exact counts of
shared shingles; a task returns a spanning forest of the links it finds.  No table of pairs is made, and no
link that could join two components is left out.

Chance of missing a pair at exactly 0.75 by banding: (1 - 0.75^5)^51, about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.llm.components import components, forest
from mintweave.session import cut

SHINGLE = 5
REGISTERS = 256
MANTISSA = 10
BAND = 5
WIDE = 1366
LARGE = 1024
#: Documents compared with each other in one task.
TILE = 1024
#: Standard deviations of the estimate that a candidate may lie below the threshold.
SLACK = 5.0
EMPTY = 0

_FAMILY = np.random.default_rng(77).integers(1, 2**63, (2, REGISTERS), dtype=np.uint64) | np.uint64(1)


def compress(low: np.ndarray) -> np.ndarray:
    """Registers from smallest hashes: 1 + (leading zeros, next ``MANTISSA`` bits); 0 is an empty register."""
    fraction, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62).astype(np.uint16)
    tail = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1).clip(0).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) + tail + np.uint16(1)


def sketch_narrow(shingles: np.ndarray) -> np.ndarray:
    """One hash function per register over a small set."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        part = shingles[at:at + 256, None]
        low = np.minimum(low, ((part ^ _FAMILY[0]) * _FAMILY[1]).min(axis=0))
    return compress(low)


def sketch_wide(shingles: np.ndarray) -> np.ndarray:
    """One register per value of the hash's leading bits; ``shingles`` is sorted."""
    bits = REGISTERS.bit_length() - 1
    bucket = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[bucket[first]] = compress(shingles[first] << np.uint64(bits))
    return out


def document_sets(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for at, end, data, offsets in C.text_steps(batch, text):
        data = C.LOWER[data]
        starts, ends, first = C.word_spans(data, offsets)
        hashes = C.word_hashes(data, starts, ends)
        runs = C.run_hashes(hashes, SHINGLE)
        for i in range(end - at):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= SHINGLE:
                found = np.sort(runs[lo:hi - SHINGLE + 1])
                keep = np.empty(len(found), bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield at + i, found[keep]
            elif hi > lo:
                short = np.uint64(hi - lo)
                for h in hashes[lo:hi]:
                    short = short * np.uint64(0x9E3779B97F4A7C15) + h
                yield at + i, C.mix(np.array([short], np.uint64))
            else:
                yield at + i, np.zeros(0, np.uint64)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n, s1, s2, narrow, wide`` per text: set size, 128-bit set sum and the two sketches (null where not kept)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, rows = 0, []
        for _, found in document_sets(batch, "text"):
            n = len(found)
            sums = (int(found.sum(dtype=np.uint64)), int(C.mix(found ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)))
            rows.append((n, *sums, sketch_narrow(found).tobytes() if 0 < n <= WIDE else None, sketch_wide(found).tobytes() if n > LARGE else None))
            if len(rows) == 512 or at + len(rows) == batch.num_rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(rows)), pa.array(columns[0], pa.int64()), *(pa.array(np.array(columns[k], np.uint64).view(np.int64)) for k in (1, 2)), *(pa.array(columns[k], pa.binary()) for k in (3, 4))],
                    names=["id", "n", "s1", "s2", "narrow", "wide"],
                )
                at, rows = at + len(rows), []

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return C.per_batch(rows, work, "id long, n long, s1 long, s2 long, narrow binary, wide binary")


def bands(classes: DataFrame) -> DataFrame:
    """``bucket, id`` for every band without an empty register."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        count = REGISTERS // BAND
        for kind in (1, 2):
            have = np.flatnonzero(np.asarray(batch.column(kind).is_valid()))
            if not len(have):
                continue
            sig = np.frombuffer(b"".join(batch.column(kind).drop_null().to_pylist()), np.uint16).reshape(len(have), REGISTERS)
            parts = sig[:, : count * BAND].reshape(len(have), count, BAND)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(count, dtype=np.uint64) + np.uint64(1000 * kind), (len(have), count))
                for k in range(BAND):
                    key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k].astype(np.uint64))
            full = (parts != EMPTY).all(axis=2)
            yield pa.RecordBatch.from_arrays([pa.array(key[full].view(np.int64)), pa.array(np.repeat(ids[have], count)[full.ravel()])], names=["bucket", "id"])

    return C.per_batch(classes.select("id", "narrow", "wide"), work, "bucket long, id long")


def plausible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose corrected estimate reaches the threshold less ``SLACK`` deviations and whose sizes allow it."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        na, nb = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
        keep = np.zeros(len(na), bool)
        for left, right in ((4, 6), (5, 7)):
            both = np.asarray(batch.column(left).is_valid()) & np.asarray(batch.column(right).is_valid())
            if both.any():
                x, y = (np.frombuffer(b"".join(batch.column(k).filter(pa.array(both)).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (left, right))
                filled = (x != EMPTY) | (y != EMPTY)
                same = ((x == y) & filled).sum(axis=1)
                ratio = np.maximum(na[both], nb[both]) / np.minimum(na[both], nb[both])
                # registers of two unrelated sets agree by accident of the short mantissa
                chance = 0.1699 * REGISTERS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
                estimate = (same - chance) / np.maximum(filled.sum(axis=1), 1)
                keep[both] |= estimate >= threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5
        keep &= np.minimum(na, nb) >= threshold * np.maximum(na, nb)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    side = lambda s: classes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("narrow").alias(f"narrow{s}"), F.col("wide").alias(f"wide{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "narrowa", "widea", "narrowb", "wideb")
    return C.per_batch(both, work, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``id, members`` (sorted 64-bit shingles) of the documents in ``wanted``."""

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, found = 0, []
        for _, members in document_sets(batch, "text"):
            found.append(members.tobytes())
            if len(found) == 256 or at + len(found) == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array(found, pa.binary())], names=["id", "members"])
                at, found = at + len(found), []

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    kept = C.likely(rows.filter("id is not null"), wanted, "id")[0].join(wanted, "id", "left_semi")
    return C.per_batch(kept, sets, "id long, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole sets satisfy ``100 * |A n B| >= percent * |A u B|``."""

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            spot = np.searchsorted(a, b)
            spot[spot == len(a)] = 0
            shared = int((a[spot] == b).sum())
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    side = lambda s: sets.withColumnsRenamed({"id": s, "members": f"set{s}"})
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "seta", "setb")
    return C.per_batch(both, compare, "a long, b long")


def tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links ``a, b`` among documents of one ``family`` that lie in different ``component``s.

    A family is dealt to tiles of about ``TILE`` documents; each pair of tiles is one task's work.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    dealt = members.join(sizes, "family").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = dealt.select("family", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "id", "component").join(sets, "id")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        ids, groups = frame["id"].to_numpy(np.int64), frame["component"].to_numpy(np.int64)
        held = [np.frombuffer(m, np.uint64) for m in frame["members"]]
        size = np.array([len(h) for h in held])
        owner = np.repeat(np.arange(len(held)), size)
        _, code, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        common = often[code] > 1
        owner, code = owner[common], code[common]
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        shared = np.zeros((len(held), len(held)), np.float32)
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            lo, hi = np.searchsorted(code, [at, at + 4096])
            part = np.zeros((len(held), 4096), np.float32)
            part[owner[lo:hi], code[lo:hi] - at] = 1
            used = np.unique(owner[lo:hi])
            shared[np.ix_(used, used)] += part[used] @ part[used].T
        linked = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
        linked &= groups[:, None] != groups[None, :]
        a, b = np.nonzero(np.triu(linked, 1))
        node, root = forest(ids[a], ids[b])
        return pd.DataFrame({"a": root, "b": node})

    return placed.groupBy("family", "low", "high").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every text, linked where ``100 * |A n B| >= percent * |A u B|``.

    Ids must be unique integers; a row without id has its ``n_shingles``, links with nothing and is a component of its own,
    without id.  Null, empty and blank texts have no shingles and link with nothing; a text
    of fewer than five words is one shingle.  Repeated texts share a class.  Other columns are not read.
    """
    sketch = cut(sketches(docs, key, text), "sketch")
    solid = sketch.filter("n > 0 and id is not null")
    same = ["n", "s1", "s2"]
    classes = cut(solid.groupBy(*same).agg(F.min_by(F.struct("narrow", "wide"), "id").alias("k"), F.min("id").alias("id")).select("id", *same, "k.*"), "classes")

    rows = bands(classes)
    low = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("bucket", "low")
    shared = cut(rows.join(low, "bucket"), "buckets")

    stars = cut(plausible(shared.filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), classes, percent / 100), "pairs")
    sets = shingle_sets(docs, stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), key, text)
    links = cut(confirmed(stars, sets, percent), "links")
    found = cut(components(links), "found")

    placed = shared.select("bucket", "id").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("low")).filter("x < y").select("bucket", "low")
    open_ = cut(placed.join(split, "bucket").select("id", "component", "low").distinct(), "open")
    families = components(open_.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnsRenamed({"node": "id", "component": "family"})
    members = cut(open_.select("id", "component").distinct().join(families, "id"), "members")
    more = cut(tiled(members, shingle_sets(docs, members.select("id"), key, text), percent), "links")
    final = components(links.unionByName(more))

    of_class = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    joined = solid.select("id", *same).join(of_class, same).select("id", "n", "component_id")
    none = sketch.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return joined.unionByName(none).withColumnRenamed("n", "n_shingles")


def representatives(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns as they are, that no smaller id of their component replaces; a null id is kept."""
    found = near_duplicates(docs.filter(F.col(key).isNotNull()), percent, key, text)
    gone = cut(found.filter("id <> component_id").select("id"), "gone")
    maybe, surely = C.likely(docs.filter(F.col(key).isNotNull()), gone, key)
    stay = maybe.join(gone, maybe[key] == gone["id"], "left_anti")
    return stay.unionByName(surely).unionByName(docs.filter(F.col(key).isNull()))
