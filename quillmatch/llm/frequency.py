"""How many sets have a shingle, in classes: counted from sorted hash runs, told by bitmaps of bounded size.

A task sorts the hashes of its sets and cuts them into buckets by their first bits; a bucket of a run is the differences of
neighbours in as few bytes as they need, so counting all shingles moves four or five bytes for each and no row. Where the
runs of a bucket meet they are merged and counted, and the bucket's own segments of the bitmaps are made: one for each
class, of a size that follows from its keys. ``Levels`` puts the segments together.

Counts are of 48-bit prefixes of the hashes, bitmaps may let further keys pass, and copies of a set in several tasks count
several times. So a class may be too high and never too low; class 0 (at most one set) is certain. Whoever uses the classes
as a global order needs no more: the order is one and the same for all sets.
"""

from __future__ import annotations

import numpy as np

from .bitmap import MAX_BITS
from .kernel import U, mix

#: Class ``k`` is of at least ``FREQUENCIES[k - 1]`` sets.
FREQUENCIES = (2, 8, 64, 1024, 16384)
PROBES, BITS_A_KEY = 4, 16
_KEY_BITS = 48


def bucket_bits(partitions: int) -> int:
    """Some eight buckets for each partition, so that partitions are even and a bucket is small."""
    return max(4, (8 * partitions - 1).bit_length())


def runs(hashes: np.ndarray, bits: int) -> tuple[list[int], list[bytes]]:
    """Buckets and their packed runs for some 64-bit hashes; a hash that comes twice is counted twice."""
    keys = np.sort(hashes) >> U(64 - _KEY_BITS)
    bucket = keys >> U(_KEY_BITS - bits)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return [], []
    steps = np.empty_like(keys)
    steps[1:] = keys[1:] - keys[:-1]
    steps[first] = keys[first] - (bucket[first] << U(_KEY_BITS - bits))
    widths = (np.frexp(np.maximum.reduceat(steps, first).astype(np.float64))[1] + 7) // 8
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = np.append(first[1:], len(keys))
    out = [bytes([w]) + np.ascontiguousarray(raw[a:b, :w]).tobytes() for a, b, w in zip(first.tolist(), ends.tolist(), np.maximum(widths, 1).tolist())]
    return bucket[first].astype(np.int64).tolist(), out


def unpacked(bucket: int, run: bytes, bits: int) -> np.ndarray:
    """The sorted keys of a packed run."""
    width = run[0]
    packed = np.frombuffer(run, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(packed), 8), np.uint8)
    steps[:, :width] = packed
    return np.cumsum(steps.view("<u8").ravel(), dtype=U) + (U(bucket) << U(_KEY_BITS - bits))


def _places(h: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th bit of mixed keys in segments of ``size`` bits."""
    return ((((h & U(0xFFFFFFFF)) + U(k) * (h >> U(32))) & U(0xFFFFFFFF)) * size) >> U(32)


def segments(keys: np.ndarray, bits: int) -> list[bytes]:
    """The segments of one bucket, a class each; ``keys`` are those of all its runs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    out = []
    for least in FREQUENCIES:
        often = keys[first[counts >= least]]
        if not len(often):
            out.append(b"")
            continue
        size = min(-(-len(often) * BITS_A_KEY // 8) * 8, max(64, (MAX_BITS >> bits) // 8 * 8))
        held, mixed = np.zeros(size, bool), mix(often)
        for k in range(PROBES):
            held[_places(mixed, U(size), k).astype(np.int64)] = True
        out.append(np.packbits(held, bitorder="little").tobytes())
    return out


class Levels:
    """The classes of all shingles, from ``{bucket: segments}``."""

    def __init__(self, by_bucket: dict[int, list[bytes]], bits: int):
        self.bits, self.tables = bits, []
        for level in range(len(FREQUENCIES)):
            size = np.zeros(1 << bits, np.int64)
            for k, made in by_bucket.items():
                size[k] = len(made[level])
            if not size.any():
                break
            held = b"".join(by_bucket[k][level] for k in sorted(by_bucket))
            self.tables.append((np.cumsum(size) - size, (size * 8).astype(U), np.frombuffer(held, np.uint8)))

    def _has(self, table, keys: np.ndarray) -> np.ndarray:
        offset, size, held = table
        bucket = (keys >> U(_KEY_BITS - self.bits)).astype(np.int64)
        left, mixed = np.flatnonzero(size[bucket] > 0), mix(keys)
        for k in range(PROBES):
            mine = bucket[left]
            at = _places(mixed[left], size[mine], k)
            left = left[(held[offset[mine] + (at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
        return left

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The class of each hash."""
        out = np.zeros(len(hashes), np.int8)
        keys, left = hashes >> U(64 - _KEY_BITS), np.arange(len(hashes))
        for k, table in enumerate(self.tables):
            left = left[self._has(table, keys[left])]
            if not len(left):
                break
            out[left] = k + 1
        return out
