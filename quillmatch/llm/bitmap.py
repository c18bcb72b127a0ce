"""Bitmaps of bounded size that stand for a set of 64-bit keys: no key of the set is missed, others may pass.

The bits are set by a native aggregation with a map-side combine; only the finished words, of a number that
``max_bits`` bounds, come to the driver and go out again as a broadcast. A bitmap only saves work: what passes it
wrongly is thrown out by the exact step behind it, so at any size of the input the result stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 128 MB: the most that is ever collected and broadcast for one bitmap.
MAX_BITS = 1 << 30
#: Places of a key.
PROBES = 4
#: Words of a block, as which a bitmap travels: 64 KB.
BLOCK_WORDS = 1 << 13
U = np.uint64
# Fixed values of the public 64-bit xxHash algorithm, and the seed of Spark's xxhash64().
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = U(42)


def xxhash64(keys: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a LONG, for unsigned 64-bit keys with the same bits."""
    k = keys.astype(U, copy=False) * _P2
    k = (k << U(31) | k >> U(33)) * _P1
    h = k ^ (_SEED + _P5 + U(8))
    h = (h << U(27) | h >> U(37)) * _P1 + _P4
    h = (h ^ h >> U(33)) * _P2
    h = (h ^ h >> U(29)) * _P3
    return h ^ h >> U(32)


class Bitmap:
    """``words`` of 64 bits, of a power-of-two number; the places of a key are steps from one end of its hash by the other."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = len(words) * 64

    def has(self, keys: np.ndarray) -> np.ndarray:
        """For each unsigned 64-bit key, whether it may be in the set."""
        h = xxhash64(keys)
        left = np.arange(len(h))
        for k in range(PROBES):
            h_left = h[left]
            at = ((h_left & U(0x7FFFFFFF)) + U(k) * (h_left >> U(32))) & U(self.bits - 1)
            left = left[(self.words[(at >> U(6)).view(np.int64)] >> (at & U(63))) & U(1) == U(1)]
        out = np.zeros(len(h), bool)
        out[left] = True
        return out


def bitmap_of(keys: DataFrame, column: str, count: int, bits_a_key: int = 16, max_bits: int = MAX_BITS) -> Bitmap:
    """The bitmap of the LONG column ``column``; its size follows from ``count``, the number of keys."""
    bits = min(max_bits, max(1 << 12, 1 << (max(1, count) * bits_a_key - 1).bit_length()))
    hashed = keys.where(F.col(column).isNotNull()).select(F.xxhash64(F.col(column).cast("long")).alias("h"))
    places = [F.expr(f"((h & 2147483647L) + {k}L * shiftrightunsigned(h, 32)) & {bits - 1}L") for k in range(PROBES)]
    rows = (
        hashed.select(F.explode(F.array(*places)).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .withColumn("block", F.expr(f"word div {BLOCK_WORDS}"))
    )
    n = max(1, bits // 64 // BLOCK_WORDS)

    def packed(batches):
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            word, value, block = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in np.unique(block).tolist():
                mine = block == k
                blocks.setdefault(k, np.zeros(BLOCK_WORDS, U))[word[mine] % BLOCK_WORDS] = value[mine].view(U)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())], names=["block", "words"])

    # Few finished blocks come to the driver, not a row for each word.
    words = np.zeros(max(bits >> 6, BLOCK_WORDS), U)
    for r in rows.repartition(min(n, 64), "block").mapInArrow(packed, "block long, words binary").collect():
        words[r["block"] * BLOCK_WORDS :][:BLOCK_WORDS] = np.frombuffer(r["words"], U)
    return Bitmap(words[: bits >> 6])
