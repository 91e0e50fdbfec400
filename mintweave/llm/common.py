"""Shared helpers of the corpus operators: UTF-8 columns as byte arrays, word spans, word hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, so all work is done on UTF-8 bytes
with whole-array numpy calls; no per-word Python object is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave.session import shared_folder

#: Bytes of text that one vectorised step handles; a longer single text is one step of its own.
STEP_BYTES = 1 << 19
#: Bits of the filter that spares most texts a shuffle; a fixed 1 MB.
FILTER = 1 << 23

#: Spark's bound on the bytes of an Arrow batch, and the value used here instead of its default of 64 MB.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.default_rng(20240607)
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def constant(frame: DataFrame) -> Column:
    """The single value of a one-row, one-column frame, as a literal that higher-order functions can use.

    A session variable holds it: lambda functions take no subqueries, and a column would be copied into every row.
    """
    spark, name = frame.sparkSession, f"value_{uuid.uuid4().hex}"
    frame.toDF("value").createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {frame.dtypes[0][1]}")
    spark.sql(f"SET VARIABLE {name} = (SELECT value FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(name)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the contract's split into folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of consecutive rows; a null text has no bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    n = len(values)
    if n == 0:
        return
    if values.null_count:
        values = values.fill_null(b"")
    _, raw_offsets, raw = values.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64, n + 1, values.offset * 8)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the number of words before it (one entry more than texts)."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _grown(n: int) -> None:
    if _powers["n"] < n:
        n = max(n, STEP_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            _powers[key] = np.multiply.accumulate(powers)
        _powers["n"] = n


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span (prefix sums, so its cost is that of the bytes)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    _grown(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODES[data] * _powers["up"][: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers["down"][starts])


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries (``len - width + 1`` of them)."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(width):
            out = out * _BASE + hashes[k:k + n]
    return mix(out)


def bounded(frame: DataFrame) -> DataFrame:
    """The frame, after its session's Arrow batches have been bounded by bytes: rows may be texts of any length.

    A bound that the session has set itself is left as it is.
    """
    conf = frame.sparkSession.conf
    if conf.get(BATCH, "67108864b") == "67108864b":
        conf.set(BATCH, f"{BATCH_BYTES}b")
    return frame


def released() -> None:
    """Give freed memory back to the system: workers live on and serve later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_batch(frame: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)
        released()

    return bounded(frame).mapInArrow(run, schema)


def bucketed(frame: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """``frame`` written once to the shared folder in buckets of ``key``: what is grouped or joined by it later does not move it again.

    There are ``parts`` buckets, or as many as a shuffle has parts where those are more (fewer would have the engine deal the table anew).
    The table's name stays in the session's catalog; its files lie beside those of ``cut``.
    """
    spark = frame.sparkSession
    buckets = min(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    table = f"{name}_{uuid.uuid4().hex}"
    frame.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark).rstrip('/')}/{table}").saveAsTable(table)
    return spark.table(table)


def binary_array(pieces: list[np.ndarray]) -> pa.Array:
    """One binary value per numpy array."""
    return pa.array([p.tobytes() for p in pieces], pa.binary())


def _slots(ids: pa.Array) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(ids.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(FILTER)).astype(np.int64)


def likely(docs: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in ``wanted``, and rows whose id is not: a bitmap of hashed ids, one fixed size for any input.

    It keeps most texts out of a join's shuffle; the join itself decides.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER, bool)
        for batch in batches:
            bits[_slots(batch.column(0))] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(FILTER // 8, np.uint8)
    for part in wanted.mapInArrow(marks, "bits binary").toLocalIterator():
        whole |= np.frombuffer(part[0], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    spot = docs.columns.index(key)

    def pick(value: bool) -> DataFrame:
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield batch.filter(pa.array(np.unpackbits(shared.value).astype(bool)[_slots(batch.column(spot))] == value))

        return per_batch(docs, work, docs.schema)

    return pick(True), pick(False)
