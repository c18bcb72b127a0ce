"""Vectorised word kernels over Arrow text columns.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; all of these are single bytes in
UTF-8, so words of bytes and words of characters agree. Everything works on the UTF-8 buffer of a batch, cut
into slices of bounded size, and never on one Python object for each word. Null texts are empty.

Hashes are polynomial in the ring of 64-bit integers with odd bases, taken from prefix sums, so that the hash of
any run costs two look-ups; a final mixer spreads them. ``seed`` picks independent families, and two families
make the 128-bit names which stand for word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 1 << 19
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _family(seed: int) -> tuple[np.ndarray, int, int]:
    table = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x2545F4914F6CDD1D % 2**64))
    base = int(mix(np.array([seed + 77], dtype=U))[0]) | 5
    base = base // 8 * 8 + 5  # of the largest multiplicative order
    return table, base, pow(base, -1, 2**64)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(seed: int, n: int, inverse: bool) -> np.ndarray:
    """The first ``n`` powers of the family's base or of its inverse; kept and doubled as needed."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        _, base, inv = _family(seed)
        size = max(1 << 12, 1 << (n - 1).bit_length())
        steps = np.full(size, inv if inverse else base, dtype=U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _POWERS[(seed, inverse)] = have
    return have[:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Mixed hashes of ``values[starts:ends]`` for each run; ``values`` are 64-bit integers."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _powers(seed, len(values), False), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(seed, len(values) + 1, True)[starts] + (ends - starts).astype(U))


class Slice:
    """Some consecutive texts of a batch: bytes, word starts and ends, and the words of each text.

    ``rows`` are the texts' places in the batch; text ``k`` has the words ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: range):
        self.data, self.offsets, self.rows = data, offsets, rows
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(rows) + 1, np.int64)
            return
        sep = _IS_SEP[data]
        before = np.empty(len(data), bool)
        before[0] = True
        before[1:] = sep[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = True
        self.starts = np.flatnonzero(~sep & before)
        after = np.empty(len(data), bool)
        after[-1] = True
        after[:-1] = sep[1:]
        after[inner - 1] = True
        self.ends = np.flatnonzero(~sep & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def word_hashes(self, seed: int, lower: bool = False) -> np.ndarray:
        """One 64-bit hash for each word."""
        if not len(self.starts):
            return np.zeros(0, U)
        table = _family(seed)[0]
        return run_hashes((table[_LOWER] if lower else table)[self.data], self.starts, self.ends, seed)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``n`` words within one text: its first word, and its text's place in the slice."""
        counts = np.diff(self.first)
        own = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
        begin = np.cumsum(np.maximum(counts - n + 1, 0)) - np.maximum(counts - n + 1, 0)
        return np.arange(len(own)) - begin[own] + self.first[:-1][own], own


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of an Arrow string column in slices of about ``limit`` bytes; a longer text has its own slice."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + limit, side="right")) - 1)
        end = min(end, n)
        yield Slice(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], range(k, end))
        k = end


def carried(keep: tuple[str, ...], added: tuple[str, ...]) -> tuple[str, ...]:
    """The columns to carry along: one with the name of an added column gives way to it."""
    return tuple(c for c in keep if c not in added)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's LONG."""
    return x.view(np.int64)
