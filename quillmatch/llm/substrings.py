"""Substring deduplication with difference-cover anchors.

A window is ``length`` consecutive words of one document. Words are removed if a window that covers them also starts in a
document with a smaller id; windows are judged on the input, and words are kept unchanged.

Places are numbered within each document, and hashes of runs of ``length - PERIOD + 1`` words are taken only at places whose
number modulo ``PERIOD`` is in the difference cover ``COVER``: any two numbers leave two members of the cover when a
suitable offset below ``PERIOD`` is added to both, so two equal windows, wherever they stand, have an equal anchor at the
same offset inside. Anchors that occur in one document only are of no further interest. Around each of the others the match
is extended: the windows over it are named by 128-bit hashes, and for each name the least document id is found.

Copies of a whole text need no windows: all their words go, if they have a window at all. So an anchor is shared only if it
occurs in two different texts. Anchors are combined before their shuffle (least and greatest text); a bitmap of bounded size
tells the second pass over the texts where to extend, and what it lets through wrongly only costs work. Windows, too, are
combined before the shuffle, and the join that brings the least id back to them is an equi-join whose large partitions
adaptive execution can split. Nothing is collected per window, anchor or document.

Defined results: null texts have no words; rows with a null id are kept whole and are never a reason to remove; rows of one
id are one document, so they never remove from each other; an empty table gives an empty result; further columns are
carried along, whatever their names. Very long texts are cut like others: a worker holds one whole, with some 40 bytes for
each byte of it while it is hashed, and its spans are as many as its repeated passages.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.batches import small_batches
from quillmatch.plans.storage import Scratch, written

from .bitmap import Bitmap, bitmap_of
from .kernel import Slice, U, run_hashes, signed, slices

#: Every difference modulo 31 is one of two members of the cover, a fixed value.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW = 50
_ANCHOR_SEED, _NAME_SEEDS, _WORD_SEEDS = 4, (5, 6), (1, 9)


def _anchors(s: Slice, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and text of each anchor of a slice."""
    starts, own = s.windows(width)
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    held = cover[(starts - s.first[:-1][own]) % PERIOD]
    starts, own = starts[held], own[held]
    return run_hashes(s.word_hashes(_WORD_SEEDS[0]), starts, starts + width, _ANCHOR_SEED), starts, own


def _merge(keys: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Least and greatest id of each distinct key."""
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begin], np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)


def _text_keys(s: Slice) -> np.ndarray:
    """The first eight bytes of each text's md5, as an unsigned number."""
    raw, at = s.data.tobytes(), s.offsets.tolist()
    return np.array([int.from_bytes(hashlib.md5(raw[a:b]).digest()[:8], "big") for a, b in zip(at, at[1:])], U)


def shared_anchors(docs: DataFrame, width: int, tmp: Scratch) -> tuple[Bitmap, int]:
    """A bitmap of the anchors that occur in two different texts or more, and their number."""

    def run(batches):
        for batch in batches:
            found = []
            for s in slices(batch.column(0)):
                h, _, own = _anchors(s, width)
                if len(h):
                    texts = signed(_text_keys(s))[own]
                    found.append(_merge(h, texts, texts))
            if found:
                h, low, high = _merge(*[np.concatenate(x) for x in zip(*found)])
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(low), pa.array(high)], names=["anchor", "low", "high"])

    anchors = docs.select("text").mapInArrow(run, "anchor long, low long, high long")
    common = anchors.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")
    common = tmp.written(common, "anchors")
    n = common.count()
    # An anchor that passes wrongly costs thirty windows, so the bitmap is a sparse one.
    return bitmap_of(common, "anchor", n, bits_a_key=32), n


def _windows_near(s: Slice, hits: np.ndarray, own: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and texts of the windows over some anchors, given by first word and text; ascending, each once."""
    begin, end = s.first[:-1][own], s.first[1:][own]
    low = np.maximum(hits - (length - width), begin)
    high = np.minimum(hits, end - length)
    good = low <= high
    marks = np.zeros(len(s.starts) + 2, np.int64)
    np.add.at(marks, low[good], 1)
    np.add.at(marks, high[good] + 1, -1)
    starts = np.flatnonzero(np.cumsum(marks[:-1])[: len(s.starts)] > 0)
    return starts, np.searchsorted(s.first, starts, side="right") - 1


#: Spark's form of ``_row_key``: tells apart the texts of rows with one id, by 31 bits of their md5.
_ROW_KEY = "cast(conv(substring(md5(cast(text as binary)), 1, 8), 16, 10) as long) & 2147483647"


def _row_key(text_keys: np.ndarray) -> np.ndarray:
    return (text_keys >> U(32)) & U(0x7FFFFFFF)


def repeated_spans(docs: DataFrame, length: int, tmp: Scratch) -> DataFrame:
    """``(doc_id, row_key, spans)``: for each text of ``docs(doc_id, text)`` with words to remove, their places.

    The result reads tables of ``tmp``.

    ``spans`` holds (first word, word behind the last) pairs, ascending and apart; it is null if all words go, provided that
    there are as many as a window has. ``row_key`` tells the texts of rows with one id apart.
    """
    if length < PERIOD:
        raise ValueError(f"windows must have {PERIOD} words at least")
    width = length - PERIOD + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    bitmap, n = shared_anchors(rows, width, tmp)
    held = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slices(batch.column(1)):
                h, at, own = _anchors(s, width)
                hit = held.value.has(h)
                if not hit.any():
                    continue
                starts, own = _windows_near(s, at[hit], own[hit], length, width)
                names = [run_hashes(s.word_hashes(w), starts, starts + length, n) for w, n in zip(_WORD_SEEDS, _NAME_SEEDS)]
                place = _row_key(_text_keys(s))[own] << U(32) | (starts - s.first[:-1][own]).astype(U)
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[0])), pa.array(signed(names[1])), pa.array(ids[s.rows.start : s.rows.stop][own]), pa.array(signed(place))], names=["a", "b", "doc_id", "place"])

    # Named twice rather than written: naming windows again costs less than their room on disk. What repeats is written, so
    # that the join has a plain exchange on both sides and adaptive execution can split a hot window.
    windows = rows.mapInArrow(run, "a long, b long, doc_id long, place long")
    least = windows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    least = tmp.written(least.select("a", "b", "low"), "windows")
    late = windows.join(least.hint("merge"), ["a", "b"]).where("doc_id > low").select("doc_id", "place")
    spans = late.groupBy("doc_id", F.shiftright("place", 32).alias("row_key")).agg(F.sort_array(F.collect_set(F.expr("cast(place & 4294967295 as int)"))).alias("at"))
    # A span begins at a window that the one before it doesn't touch.
    spans = spans.withColumn("first", F.expr(f"filter(sequence(1, size(at)), i -> i = 1 or at[i - 1] > at[greatest(i - 2, 0)] + {length})"))
    joined = f"""zip_with(first, concat(slice(first, 2, size(first)), array(size(at) + 1)), (x, y) ->
        named_struct('a', at[x - 1], 'b', at[y - 2] + {length}))"""
    parts = spans.select("doc_id", "row_key", F.expr(joined).alias("spans"))
    named = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("name"), F.expr(_ROW_KEY).alias("row_key"))
    first = named.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = named.join(first.select("name", "low"), "name").where("doc_id > low").select("doc_id", "row_key").distinct()
    return parts.join(copies, ["doc_id", "row_key"], "left_anti").unionByName(copies.select("doc_id", "row_key", F.lit(None).cast(parts.schema["spans"].dataType).alias("spans")))


def remove(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """All of ``docs`` with ``_words``, ``_removed`` (numbers of words) and ``_kept``, the words that stay, joined by one space.

    ``_kept`` is null where nothing is removed, so that untouched texts need not be copied.
    """
    columns = docs.columns
    boxed = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    with Scratch(docs.sparkSession) as tmp, small_batches(docs.sparkSession):
        spans = written(repeated_spans(docs.select("doc_id", "text"), length, tmp), "spans")
    # The texts of one id are few; all their spans go along with each and the text's own are found by its key. One plan for
    # every size: spans grow with the corpus and are never broadcast.
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row_key", "spans")).alias("_spans"))
    met = boxed.join(spans.hint("merge"), boxed["_id"] == spans["doc_id"], "left").select("_row", "_spans")
    schema = met.select("_row").schema.add("_words", "long").add("_removed", "long").add("_kept", "string")

    def run(batches):
        for batch in batches:
            spans_of = batch.column(1).to_pylist()
            n, gone, kept = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for s in slices(batch.column(0).field(columns.index("text"))):
                keys = None
                for k, row in enumerate(s.rows):
                    n[row] = int(s.first[k + 1]) - int(s.first[k])
                    if not spans_of[row] or n[row] < length:
                        continue
                    keys = _row_key(_text_keys(s)) if keys is None else keys
                    mine = [x["spans"] for x in spans_of[row] if x["row_key"] == int(keys[k])]
                    if not mine:
                        continue
                    words, out, at = s.data[s.offsets[k] : s.offsets[k + 1]].tobytes().split(), [], 0
                    for span in mine[0] or [{"a": 0, "b": len(words)}]:
                        out += words[at : span["a"]]
                        at = span["b"]
                    out += words[at:]
                    gone[row] = len(words) - len(out)
                    kept[row] = b" ".join(out).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(gone), pa.array(kept, pa.string())], names=["_row", "_words", "_removed", "_kept"])

    return met.mapInArrow(run, schema).select("_row.*", "_words", "_removed", "_kept")


def digest(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``, the digest of the kept words joined by one space."""
    made = remove(docs.select("doc_id", "text"), length)
    joined = F.expr(r"array_join(array_remove(split(coalesce(text, ''), '[ \\t-\\r]+'), ''), ' ')")
    return made.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce("_kept", joined), 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` with its own columns; texts from which words are removed hold their kept words joined by one space."""
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), "doc_id", "text")
    made = remove(boxed, length)
    return made.select(*[(F.coalesce("_kept", "text") if c == "text" else F.col("_doc").getField(c)).alias(c) for c in docs.columns])
