"""Blocked Bloom filters over 64-bit keys: a key sets five bits of one 64-bit block.

Tasks turn keys into ``block, mask``; Spark ORs the masks of a block, combining before the shuffle; the driver fetches
at most one number per block.  ``limit`` bounds the blocks of all shards together, whatever the number of keys: beyond
``limit * 64 / BITS`` keys the filters let more keys pass that were never added, and none fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C

#: Bits per key where the limit allows it.
BITS = 24
#: Blocks of all shards together (32 MB).
LIMIT = 1 << 22
_SALT = np.uint64(0xA0761D6478BD642F)


def spots(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bit mask of each key; ``blocks`` is a power of two."""
    with np.errstate(over="ignore"):
        h = C.mix(keys ^ _SALT)
    mask = np.zeros(len(h), np.uint64)
    for shift in (34, 40, 46, 52, 58):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return (h & np.uint64(blocks - 1)).astype(np.int64), mask


def holds(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been added."""
    block, mask = spots(keys, len(bits))
    return bits[block] & mask == mask


def sizes(counts: dict[int, int], limit: int = LIMIT, least: int = 1) -> dict[int, int]:
    """Blocks of each shard: a power of two for ``BITS`` bits a key and ``least`` blocks, in proportion below ``limit`` in all."""
    wanted = {shard: max(least, n * BITS // 64) for shard, n in counts.items()}
    share = min(1.0, limit / 2 / max(1, sum(wanted.values())))
    return {shard: 1 << int(max(1, n * share) - 1).bit_length() for shard, n in wanted.items()}


def build(keys: DataFrame, limit: int = LIMIT, least: int = 1) -> dict[int, np.ndarray]:
    """The filter of every shard of ``keys`` (columns ``shard int``, ``key long``; read twice)."""
    blocks = sizes({r[0]: r[1] for r in keys.groupBy("shard").count().collect()}, limit, least)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for s in np.unique(shard):
            block, mask = spots(key[shard == s].view(np.uint64), blocks[int(s)])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(block), s, np.int32)), pa.array(block), pa.array(mask.view(np.int64))], names=["shard", "block", "mask"])

    merged = C.per_batch(keys.select("shard", "key"), work, "shard int, block long, mask long").groupBy("shard", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    shard, block, mask = (merged.column(k).to_numpy() for k in range(3))
    out = {}
    for s, n in blocks.items():
        own = shard == s
        out[s] = np.zeros(n, np.uint64)
        out[s][block[own]] = mask[own].view(np.uint64)
    return out
