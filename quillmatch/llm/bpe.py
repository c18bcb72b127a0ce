"""Byte-level BPE with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes ends in zeros, so equal passages are cut alike wherever they
stand; a chunk that a worker has met before is not encoded again. Cuts move forward to the next place where the
vocabulary's pre-tokenizer always ends a token, and such joins need no repair. Where no such place is near, the
text is cut right there and the join is repaired: from the last sure token end before the cut, the text is encoded
again until its token ends agree with those of the chunk behind it.

The ids are those of the ``tokenizers`` library for the same vocabulary file, without truncation, padding or added
special tokens. The merges run in ``tiktoken``, on ranks read from that very file, because it is several times faster.

Defined results: null and empty texts have no ids; repeated rows and repeated or null ids are encoded each on its own;
an empty table gives an empty result; further columns are carried along if asked for with ``keep``. Very long texts are
encoded whole, in time that grows with their length; a token of a million bytes takes a second. A vocabulary file of
another kind raises an error.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, carried, mix, slices

#: The pre-tokenizer of byte-level BPE vocabularies, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters by which such vocabulary files write bytes: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _check(spec: dict) -> None:
    """Refuses a file that another encoder than byte-level BPE with ``PATTERN`` is meant to read."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("not a byte-level BPE vocabulary without prefix spaces")
    if spec.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        raise ValueError("a normalizer or an option of the model isn't supported")
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError("ids do not follow the order of the merges")


class Vocabulary:
    """Ranks, special tokens and bytes of each id, read from a vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.special_bytes = [s.encode() for s in self.special]
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def encode_plain(self, text: str) -> np.ndarray:
        """Ids of a text in which no string is special."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def encode(self, data: bytes) -> bytes:
        """The ids of a whole text in UTF-8, special tokens among them, as little-endian unsigned 32-bit integers."""
        if self.special_split is None or not any(s in data for s in self.special_bytes):
            return self.encode_plain(data.decode()).tobytes()
        parts = self.special_split.split(data.decode())
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.encode_plain(p).tobytes() for p in parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begins[ids] - (ends - size), size)
        return self.bytes[at].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each path and process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


class ByteCache(dict):
    """A mapping that forgets everything when its values exceed ``limit`` bytes."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size = limit, 0

    def put(self, key, value: bytes) -> bytes:
        if len(value) * 8 < self.limit:
            self.size += len(value) + len(key) + 100
            if self.size > self.limit:
                self.clear()
                self.size = len(value) + len(key) + 100
            self[key] = value
        return value


class ChunkEncoder:
    """Encodes texts by chunks; ids come as little-endian unsigned 32-bit integers in bytes."""

    WINDOW = 16
    NEAR = 96

    def __init__(self, vocab: Vocabulary, mask_bits: int = 7, limit: int = 64 << 20):
        self.vocab, self.mask_bits = vocab, mask_bits
        self.chunks = ByteCache(limit)
        self.met = self.reused = self.repaired = 0
        import regex

        self.pattern = regex.compile(PATTERN)
        step = mix(np.arange(256, dtype=U) + U(11))
        self.table = step

    def cuts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of cuts in some bytes, ascending, and whether each is a sure token end."""
        n = len(data)
        if n <= self.WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        t = self.table[data]
        h = t.copy()
        width = 1
        while width < self.WINDOW:  # hashes of 2, 4, 8 and 16 bytes, each from two of half the length
            h[width:] = h[width:] + (h[:-width] * U(0x9E3779B97F4A7C15) ^ h[:-width] >> U(17))
            width *= 2
        hit = np.flatnonzero(mix(h[self.WINDOW :]) >> U(64 - self.mask_bits) == 0) + self.WINDOW
        solid = (data > 0x20) & (data < 0x7F)
        sure = np.flatnonzero((data[1:-1] == 0x20) & solid[:-2] & solid[2:]) + 1
        near = np.searchsorted(sure, hit)
        at = sure[np.minimum(near, len(sure) - 1)] if len(sure) else np.zeros(len(hit), np.int64)
        good = (near < len(sure)) & (at - hit < self.NEAR) & (at >= hit)
        # Elsewhere the cut stays, at the start of a character.
        raw = hit.copy()
        for _ in range(3):
            raw -= (data[raw] & 0xC0) == 0x80
        places = np.where(good, at, raw)
        places, first = np.unique(places, return_index=True)
        inside = (places > 0) & (places < n)
        return places[inside], good[first][inside]

    def encode(self, data: bytes) -> bytes:
        """The ids of a text, given in UTF-8."""
        split = self.vocab.special_split
        if split is None or not any(s.encode() in data for s in self.vocab.special):
            return self._encode_part(data)
        out = []
        for part in split.split(data.decode()):
            special = self.vocab.special.get(part)
            out.append(np.array([special], "<u4").tobytes() if special is not None else self._encode_part(part.encode()))
        return b"".join(out)

    def _encode_part(self, data: bytes) -> bytes:
        places, sure = self.cuts(np.frombuffer(data, np.uint8))
        if not len(places):
            return self._chunk(data)
        bounds = [0, *places.tolist(), len(data)]
        if sure.all():
            return b"".join([self._chunk(data[a:b]) for a, b in zip(bounds, bounds[1:])])
        out, have, run = [], None, None  # have: text and ids since the last sure cut, or since a token end near the last repair
        for a, b, ok in zip(bounds, bounds[1:], [True, *sure.tolist()]):
            if run is not None:
                # A token that spans whole chunks is carried on, and encoded once when a chunk has token ends of its own.
                if not ok:
                    run.append(data[a:b].decode())
                    if sum(1 for _ in zip(self.pattern.finditer(run[-1]), range(4))) < 4:
                        continue
                text = "".join(run)
                have, run = (text, self.vocab.encode_plain(text).tobytes()), None
                if not ok:
                    continue
            chunk, ids = data[a:b], self._chunk(data[a:b])
            if ok:
                if have is not None:
                    out.append(have[1])
                have = (chunk.decode(), ids)
            elif sum(1 for _ in zip(self.pattern.finditer(have[0]), range(3))) < 3:
                run = [have[0], chunk.decode()]
            else:
                done, have = self._repaired(*have, chunk.decode(), ids)
                out.append(done)
        out.append(have[1] if run is None else self.vocab.encode_plain("".join(run)).tobytes())
        return b"".join(out)

    def _chunk(self, chunk: bytes) -> bytes:
        self.met += 1
        ids = self.chunks.get(chunk)
        if ids is not None:
            self.reused += 1
            return ids
        return self.chunks.put(chunk, self.vocab.encode_plain(chunk.decode()).tobytes())

    def _tokens(self, tokens: list[str]) -> bytes:
        """Ids of some whole tokens of the pre-tokenizer."""
        return b"".join([self.vocab.encode_plain(t).tobytes() for t in tokens])

    def _repaired(self, left: str, ids_left: bytes, right: str, ids_right: bytes) -> tuple[bytes, tuple[str, bytes]]:
        """Joins two chunks, of which the first starts at a sure token end.

        The token before the last one of ``left`` cannot change with what follows. From its end both chunks are encoded
        again, until a token ends where one of ``right`` alone ends too: what follows there is the same in both. Returns the
        ids in front of that token end, and the text and ids behind it.
        """
        self.repaired += 1
        starts = [m.start() for m in self.pattern.finditer(left)]
        x = starts[-2] if len(starts) > 1 else 0
        gap, again, alone = len(left) - x, [], []
        theirs = self.pattern.finditer(right)
        reached = 0
        for m in self.pattern.finditer(left[x:] + right):
            again.append(m.group())
            end = m.end() - gap
            while reached < end:
                t = next(theirs)
                alone.append(t.group())
                reached = t.end()
            if 0 < end == reached:
                break
        tail = len(self._tokens([m.group() for m in self.pattern.finditer(left, x)]))
        kept = len(ids_left) - tail
        joined = self._tokens(again) + ids_right[len(self._tokens(alone)) :]
        return ids_left[:kept], (left[x:] + right, joined)


_ENCODERS: dict = {}


def encoder(path: str, kind=ChunkEncoder, **options):
    """One encoder for each vocabulary and setting in a process, so that its chunks outlive a task."""
    key = (path, kind, tuple(sorted(options.items())))
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(vocabulary(path), **options)
    return _ENCODERS[key]


def texts_of(column: pa.Array):
    """The UTF-8 bytes of every text of an Arrow column."""
    for s in slices(column):
        raw, at = s.data.tobytes(), s.offsets.tolist()
        for a, b in zip(at, at[1:]):
            yield raw[a:b]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask_bits: int = 7) -> DataFrame:
    """``keep`` and for every text ``_ids``, BINARY: its ids as little-endian unsigned 32-bit integers."""
    keep = carried(keep, ("_ids", "_text"))
    kept = docs.select(*keep, docs[text].alias("_text"))
    schema = docs.select(*keep).schema.add("_ids", "binary")

    def run(batches):
        own = encoder(path, ChunkEncoder, mask_bits=mask_bits)
        for batch in batches:
            ids = [own.encode(raw) for raw in texts_of(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ids, pa.binary())], names=[*keep, "_ids"])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the text of ``_ids``, as ``_text``."""
    keep = carried(keep, ("_ids", "_text"))
    schema = encoded.select(*keep).schema.add("_text", "string")

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            texts = [vocab.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "_text"])

    return encoded.select(*keep, "_ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask_bits: int = 7) -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text.

    Ids and decoded texts are digested in the task that made them; neither is moved or kept.
    """
    keep = carried(keep, ("n_tokens", "ids_sha256", "decoded_sha256", "_text"))
    kept = docs.select(*keep, docs[text].alias("_text"))
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        own = encoder(path, ChunkEncoder, mask_bits=mask_bits)
        for batch in batches:
            n, a, b = [], [], []
            for raw in texts_of(batch.column(len(keep))):
                ids = own.encode(raw)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(own.vocab.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            arrays = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return kept.mapInArrow(run, schema)
