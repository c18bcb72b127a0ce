"""Document fingerprints: SimHash with weighted terms, and permuted block tables to search them.

Terms are the runs of three words of a text (all of its words, if fewer); a term's weight is its occurrences times its
bytes. Each bit of a fingerprint is the sign of the weights' sum, counted with the sign of that bit in the term's hash.
Sums are of whole numbers, so equal texts have equal fingerprints on every machine. Likeness is the share of equal bits.

``near`` finds all fingerprints within a Hamming radius. Up to ``TABLES_RADIUS``, of ``radius + 2`` blocks of bits at least
two are equal, so one of the permuted tables, each keyed by a pair of blocks, holds the partner. Beyond, as for ``RADIUS``,
which texts of shingle Jaccard ``SIMILARITY`` are apart on average, of ``PARTS`` blocks at least one differs in no more
than ``radius // PARTS`` bits: slabs of queries meet slabs of fingerprints, and each looks up the few keys that near. Equal
fingerprints are searched once. ``near_counts`` only counts, so a large group of near copies makes no pairs.

Defined results: null and empty texts, and those of separators only, have the fingerprint of zeros; repeated rows have
equal fingerprints; an empty table gives an empty result. In ``edited`` null ids come before all others, rows of one id in
the order of their texts; the last document is followed by the first that has an id, itself if it is alone. Further columns
are left out unless asked for with ``keep``. Very long texts are one fingerprint like others, their terms counted in blocks.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Slice, carried, run_hashes, slices

BITS = 128
TERM_WORDS = 3
_BLOCK = 1 << 13
#: The shingle Jaccard from which texts are near copies, and the bits that sets so alike, of cosine 2J / (1 + J), are apart.
SIMILARITY = 0.75
RADIUS = round(BITS * math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi)
TABLES_RADIUS, PARTS, PART_BITS = 4, 8, 16
#: Queries, and fingerprints, of a slab at most (on average); candidates that are compared at once.
SLAB_QUERIES, SLAB_PRINTS, CANDIDATES = 1 << 15, 1 << 17, 1 << 20


def fingerprints_of(s: Slice) -> list[str]:
    """The fingerprints of the texts of a slice, in hexadecimal."""
    words = s.word_hashes(1)
    out = []
    for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist()):
        if a == b:
            out.append("0" * (BITS // 4))
            continue
        width = min(TERM_WORDS, b - a)
        starts = np.arange(a, b - width + 1)
        weight = (s.ends[starts + width - 1] - s.starts[starts]).astype(np.float64)
        own = words[a:b]
        hashed = [run_hashes(own, starts - a, starts - a + width, seed) for seed in (2, 3)]
        both = np.stack(hashed, axis=1).astype(">u8")
        votes = np.zeros(BITS)
        for k in range(0, len(both), _BLOCK):
            bits = np.unpackbits(both[k : k + _BLOCK].view(np.uint8).reshape(-1, BITS // 8), axis=1)
            votes += weight[k : k + _BLOCK] @ bits.astype(np.float64)
        out.append(np.packbits(votes * 2 > weight.sum()).tobytes().hex())
    return out


def fingerprint(docs: DataFrame, columns: dict[str, str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the fingerprint of each text column; ``columns`` maps text columns to the names of the results."""
    keep = carried(keep, tuple(columns.values()))
    n, schema = len(keep), docs.select(*keep).schema
    for name in columns.values():
        schema = schema.add(name, "string")

    def run(batches):
        for batch in batches:
            made = [pa.array([x for s in slices(c) for x in fingerprints_of(s)], pa.string()) for c in batch.columns[n:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=schema.names)

    return docs.select(*keep, *columns).mapInArrow(run, schema)


def likeness(a: str | Column, b: str | Column) -> Column:
    """The share of equal bits of two fingerprints, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    differ = F.lit(0)
    for k in range(0, BITS // 4, 8):
        halves = [F.conv(F.substring(x, k + 1, 8), 16, 10).cast("long") for x in (a, b)]
        differ = differ + F.bit_count(halves[0].bitwiseXOR(halves[1]))
    return 1 - differ / F.lit(float(BITS))


def with_next(docs: DataFrame, text: str = "text", divisions: int | None = None) -> DataFrame:
    """``doc_id``, ``_text`` and ``_next``, the text of the document with the next id.

    Documents are dealt by ranges of the id, whose bounds are ids of the table; the first document of a range is sent to
    the range before it as well, so each range is complete and no task sees more than its own.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    n = divisions or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / n) for k in range(n)])
    bounds = sorted(set(base.agg(F.percentile_approx("doc_id", shares, F.lit(20 * n))).first()[0] or []))
    if bounds:
        bounds[0] = base.agg(F.min("doc_id")).first()[0]
    if not bounds:  # no ids at all
        bounds = [0]
    edges = "array(" + ", ".join(f"{b}L" for b in bounds) + ")"
    # how many bounds are not above the id; nulls belong to the first range
    own = F.expr(f"greatest(size(filter({edges}, b -> b <= doc_id)) - 1, 0)")
    sent = base.withColumn("_range", own).withColumn("_guest", F.lit(False))
    guests = base.where(F.col("doc_id").isin(bounds)).withColumn(
        "_range", F.expr(f"pmod(array_position({edges}, doc_id) - 2, {len(bounds)})").cast("int")
    )
    both = sent.union(guests.withColumn("_guest", F.lit(True)).select(*sent.columns))
    within = Window.partitionBy("_range").orderBy("_guest", "doc_id", "_text")
    return both.withColumn("_next", F.coalesce(F.lead("_text").over(within), F.col("_text"))).where(~F.col("_guest")).select("doc_id", "_text", "_next")


def edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last quarter of code points replaced by the first as many of the next document.
    """
    pairs = with_next(docs, text).withColumn("n_chars", F.length("_text").cast("long"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    made = pairs.select(
        "doc_id",
        "n_chars",
        "_text",
        F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("_next"), F.lit(1), quarter)).alias("_edited"),
        "_next",
    ).withColumn("edited_sha256", F.sha2(F.col("_edited"), 256))
    names = {"_text": "fingerprint", "_edited": "edited_fingerprint", "_next": "_next_fingerprint"}
    prints = fingerprint(made, names, ("doc_id", "n_chars", "edited_sha256"))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next_fingerprint").alias("near_next"),
    )


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def within(queries: np.ndarray, prints: np.ndarray, radius: int):
    """Yield ``(q, p, distance)``: each pair of rows of two ``[n, PARTS]`` arrays of 16-bit parts within ``radius``, once."""
    flips = radius // PARTS
    masks = np.array([sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(PART_BITS), n)], np.int64)
    for part in range(PARTS):
        own = prints[:, part].astype(np.int64)
        order = np.argsort(own, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=1 << PART_BITS))])
        step = max(1, CANDIDATES // len(masks))
        for k in range(0, len(queries), step):
            keys = queries[k : k + step, part].astype(np.int64)[:, None] ^ masks
            first, size = edges[keys], edges[keys + 1] - edges[keys]
            found = np.flatnonzero(size)
            first, size, asks = first.ravel()[found], size.ravel()[found], k + found // len(masks)
            done = np.cumsum(size)
            at = 0
            while at < len(size):
                end = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CANDIDATES, side="right")))
                n = size[at:end]
                q = np.repeat(asks[at:end], n)
                p = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[at:end], n)]
                apart = _differing(queries[q].view(np.uint64), prints[p].view(np.uint64)).sum(axis=1)
                near = apart <= radius
                q, p, apart = q[near], p[near], apart[near]
                # a pair belongs to the first part that finds it
                new = (_differing(queries[q][:, :part], prints[p][:, :part]) > flips).all(axis=1)
                yield q[new], p[new], apart[new]
                at = end


def _parts(fingerprints: pa.ChunkedArray) -> np.ndarray:
    raw = bytes.fromhex("".join(fingerprints.to_pylist()))
    return np.ascontiguousarray(np.frombuffer(raw, ">u2").reshape(-1, PARTS).astype(np.uint16))


def _met(queries: DataFrame, prints: DataFrame, made, schema: str) -> DataFrame:
    """``made(queries, prints)`` for each slab of distinct queries and each of distinct fingerprints, as Arrow tables."""
    asked = queries.select("fingerprint").where("fingerprint is not null").distinct()
    n_asked, n = asked.count(), prints.count()
    rows, columns = -(-n_asked // SLAB_QUERIES) or 1, -(-n // min(max(n // 16, 1 << 11), SLAB_PRINTS)) or 1

    def slab(of: int, seed: int):
        return F.pmod(F.xxhash64("fingerprint", F.lit(seed)), F.lit(of)).cast("int")

    def every(of: int):
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    left = asked.select("fingerprint", slab(rows, 5).alias("_row"), every(columns).alias("_column"))
    right = prints.select(*prints.columns, slab(columns, 6).alias("_column"), every(rows).alias("_row"))
    return left.groupBy("_row", "_column").cogroup(right.groupBy("_row", "_column")).applyInArrow(made, schema)


def near_counts(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(query, n)``: how many rows of ``prints`` are within ``radius`` bits of each distinct query that has any.

    Both inputs have a column ``fingerprint``; nulls match nothing.
    """
    sizes = prints.where("fingerprint is not null").groupBy("fingerprint").count()

    def made(asked: pa.Table, held: pa.Table) -> pa.Table:
        n = np.zeros(len(asked), np.int64)
        if len(asked) and len(held):
            weight = held["count"].to_numpy()
            for q, p, _ in within(_parts(asked["fingerprint"]), _parts(held["fingerprint"]), radius):
                np.add.at(n, q, weight[p])
        kept = np.flatnonzero(n)
        return pa.table({"query": asked["fingerprint"].take(kept), "n": n[kept]})

    return _met(queries, sizes, made, "query string, n long").groupBy("query").agg(F.sum("n").alias("n"))


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(query, fingerprint, distance)`` for all distinct fingerprints within ``radius`` bits of a distinct query.

    Both inputs have a column ``fingerprint``; nulls match nothing.
    """
    if radius > TABLES_RADIUS:

        def made(asked: pa.Table, held: pa.Table) -> pa.Table:
            found = [np.zeros((3, 0), np.int64)]
            if len(asked) and len(held):
                found += [np.stack(x) for x in within(_parts(asked["fingerprint"]), _parts(held["fingerprint"]), radius)]
            q, p, apart = np.concatenate(found, axis=1)
            return pa.table({"query": asked["fingerprint"].take(q), "fingerprint": held["fingerprint"].take(p), "distance": apart.astype(np.int32)})

        distinct = prints.select("fingerprint").where("fingerprint is not null").distinct()
        return _met(queries, distinct, made, "query string, fingerprint string, distance int")
    digits, blocks = BITS // 4, radius + 2
    cuts = [digits * k // blocks for k in range(blocks + 1)]

    def tables(rows: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[
            F.concat(F.lit(f"{i}.{j}."), *[F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in (i, j)])
            for i, j in combinations(range(blocks), 2)
        ])
        return rows.select("fingerprint").where("fingerprint is not null").distinct().select(F.col("fingerprint").alias(name), F.explode(keys).alias("_key"))

    met = tables(queries, "query").join(tables(prints, "_other"), "_key").select("query", F.col("_other").alias("fingerprint"))
    apart = F.round((1 - likeness("query", "fingerprint")) * BITS).cast("int").alias("distance")
    return met.select("query", "fingerprint", apart).where(F.col("distance") <= radius).distinct()
