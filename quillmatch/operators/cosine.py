"""Exact all-pairs weighted-cosine joins over sparse vectors in long form ``(id, dim, w)``.

Dimensions that a single vector has add to no product and go first. The others are ordered by how many vectors have them, the
most frequent ahead. The leading part of a vector whose length stays below the threshold is not held: as all vectors have
length 1 at most, two that reach the threshold meet in a dimension that both hold. Vectors travel whole to the dimensions they
hold, so a product is decided where two of them meet and only pairs that reach the threshold are moved. Sums are compared with
a slack of 1e-9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.plans.meetings import dealt, partners
from quillmatch.plans.meetings import ramp as _ramp
from quillmatch.plans.storage import written

SLACK = 1e-9
#: Vectors that meet in one dimension at once; rows of a group of rarer dimensions, about; entries looked up at once.
BLOCK, BUCKET, CHUNK = 512, 4096, 1 << 21
#: Where all meet all: blocks at least, vectors and entries of a block at most, and pairs of rows that are summed up at once.
BLOCKS, SIDE, SIDE_ENTRIES, CELLS = 8, 1 << 16, 2_000_000, 1 << 21


def document_frequency(tokens: DataFrame) -> DataFrame:
    """``(tok, df)`` of exploded ``(id, tok)`` rows."""
    return tokens.groupBy("id", "tok").agg(F.count("*").alias("tf")).groupBy("tok").agg(F.count("*").alias("df"))


def exploded(docs: DataFrame, idx: str, tokens: Column) -> DataFrame:
    """``(id, tok)``: one row for each token of each document; null tokens and ids are left out."""
    return docs.select(F.col(idx).cast("long").alias("id"), F.explode(tokens).alias("tok")).where("id is not null and tok is not null")


def tfidf(docs: DataFrame, idx: str, tokens: Column) -> DataFrame:
    """``(id, dim, w)``: raw TF-IDF weights above 0; the logarithm's numerator counts all documents."""
    n = docs.where(F.col(idx).isNotNull()).count()
    tf = exploded(docs, idx, tokens).groupBy("id", "tok").agg(F.count("*").alias("tf"))
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log(F.lit(float(n)) / F.col("df"))
    return tf.join(df, "tok").select("id", F.col("tok").alias("dim"), weight.alias("w")).where("w > 0")


def normalised(rows: DataFrame) -> DataFrame:
    """``(id, dim, w)`` with repeated dimensions summed, zero weights dropped and every vector of length 1."""
    summed = rows.where("id is not null and dim is not null").groupBy("id", "dim").agg(F.sum("w").alias("w")).where("w <> 0")
    norms = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return summed.join(norms, "id").select("id", "dim", (F.col("w") / F.col("norm")).alias("w"))


def dim_ranks(vectors: DataFrame) -> DataFrame:
    """``(dim, maxw, rank)``: dimensions by greatest weight and then by name, ascending from 1: a report of all.

    Dimensions are dealt by ranges; a rank is the place within its range behind the sizes of the ranges before.
    """
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    greatest = vectors.groupBy("dim").agg(F.max("w").alias("maxw"))
    dealt = written(greatest.repartitionByRange(n, "maxw", "dim").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("maxw", "dim"))
    return dealt.withColumn("_place", within).join(before, "_range").select("dim", "maxw", (F.col("_before") + F.col("_place")).alias("rank"))


def short_names(tokens: Column) -> Column:
    """Tokens by 16 bytes each, their MD5, so that long tokens are not moved as dimensions."""
    return F.transform(tokens, lambda x: F.unhex(F.md5(x.cast("binary"))))


def indexed(vectors: DataFrame, t: float) -> DataFrame:
    """``(id, rest, entries)``: vectors with their shared dimensions as ``(ord, d, w, held, below)``, in the order of ``dim_ranks``.

    ``held`` is false for the leading dimensions of a vector that together cannot reach ``t``; ``below`` is the length of the
    part of a vector before a dimension, ``rest`` that of its left-out dimensions.
    """
    if dict(vectors.dtypes)["dim"] == "string":
        vectors = vectors.withColumn("dim", F.unhex(F.md5(F.col("dim").cast("binary"))))
    greatest = vectors.groupBy("dim").agg(F.max("w").alias("maxw"), F.count("*").alias("df")).withColumn("d", F.monotonically_increasing_id())
    order = Window.partitionBy("id").orderBy("maxw", "dim")
    reach = F.sum(F.col("w") * F.col("maxw")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    below = F.sqrt(F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = vectors.join(written(greatest, "greatest"), "dim")
    ranked = ranked.select("id", F.row_number().over(order).alias("ord"), "d", "w", (reach >= t - SLACK).alias("held"), below.alias("below"), "df")
    rest = F.sqrt(F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("w") * F.col("w"))))
    shared = F.collect_list(F.when(F.col("df") > 1, F.struct("ord", "d", "w", "held", "below")))
    return ranked.groupBy("id").agg(rest.alias("rest"), F.sort_array(shared).alias("entries")).where("size(entries) > 0")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """``rows``, one for each vector with ``entries``, once for each pair of blocks that has to meet: ``pair`` and ``side``.

    The blocks grow with the input up to a bound, so that rows are moved a constant number of times until then.
    """
    n, size = rows.agg(F.count("*"), F.sum(F.size("entries"))).first()
    blocks = max(BLOCKS, n // SIDE + 1, (size or 0) // SIDE_ENTRIES + 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = F.least("block", "other") * blocks + F.greatest("block", "other")
    return dealt.withColumn("pair", pair).withColumn("side", F.expr("if(other < block, 1, 0)")).drop("block", "other")


class _Side:
    """Vectors of one side of a meeting: entries by vector, and by dimension as postings."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("id").to_numpy()
        self.size, entries = _lists(table.column("entries"))
        self.begin = np.cumsum(self.size) - self.size
        self.entries = {entries.type[k].name: entries.field(k).to_numpy(zero_copy_only=False) for k in range(entries.type.num_fields)}
        self.row = np.repeat(np.arange(len(self.ids)), self.size)
        self.by_dim = np.argsort(self.entries["d"], kind="stable")
        self.dims, self.first, self.count = np.unique(self.entries["d"][self.by_dim], return_index=True, return_counts=True)


def _postings(left: _Side, right: _Side, backward: bool = False):
    """The products of two sides by slices of rows of the left: ``(first row, rows, pieces)``; a piece is ``(e, f, cell)``,
    an entry of the left, one of the right with its dimension, and the cell of their rows in the slice.

    Entries of a row come in their order, or ``backward``.
    """
    n = len(right.ids)
    step = max(1, CELLS // max(n, 1))
    for at in range(0, len(left.ids) if n else 0, step):
        to = min(at + step, len(left.ids))
        mine = np.arange(left.begin[at], left.begin[to - 1] + left.size[to - 1])
        if backward:
            mine = mine[::-1]
        place = np.minimum(np.searchsorted(right.dims, left.entries["d"][mine]), max(len(right.dims) - 1, 0))
        known = np.flatnonzero(right.dims[place] == left.entries["d"][mine]) if len(right.dims) else np.zeros(0, np.int64)
        mine, place = mine[known], place[known]

        def pieces(mine=mine, place=place, at=at):
            total, k = np.cumsum(right.count[place]), 0
            while k < len(mine):
                end = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + CHUNK, side="right")))
                owner, ramp = _ramp(right.count[place[k:end]])
                f = right.by_dim[right.first[place[k:end]][owner] + ramp]
                e = mine[k:end][owner]
                yield e, f, (left.row[e] - at) * n + right.row[f]
                k = end

        yield at, to - at, pieces()


def _sides(table: pa.Table) -> tuple[_Side, _Side, bool]:
    side = table.column("side").to_numpy()
    two = bool(side.any())
    left = _Side(table.filter(pa.array(side == 0)) if two else table)
    return left, _Side(table.filter(pa.array(side == 1))) if two else left, two


def _shared(vectors: DataFrame) -> DataFrame:
    """``(dim, d, df)``: the dimensions of two vectors or more, numbered; written, so that numbers stay."""
    df = vectors.groupBy("dim").agg(F.count("*").alias("df")).where("df > 1")
    return written(df.withColumn("d", F.monotonically_increasing_id()), "dims")


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists of a column and all their elements."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), whole.flatten()


def _reached(table: pa.Table, t: float) -> pa.Table:
    """Pairs of rows that meet in ``(d, lo, hi)``, where their product reaches ``t`` and they hold no smaller ``d`` both."""
    table = table.sort_by([("d", "ascending"), ("lo", "ascending"), ("hi", "ascending"), ("side", "ascending")])
    d, lo, hi, side, ids = (table.column(c).to_numpy() for c in ("d", "lo", "hi", "side", "id"))
    size, entries = _lists(table.column("entries"))
    dim, w, held = (entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    begin = np.cumsum(size) - size
    names, local = np.unique(dim, return_inverse=True)
    own = np.searchsorted(names, d)
    key = np.repeat(np.arange(len(d)), size) * len(names) + local  # ascending: entries come by dimension
    first, count = partners([d], lo, hi, side)
    left, step = _ramp(count)
    right = first[left] + step
    less = size[left] <= size[right]
    left, right = np.where(less, left, right), np.where(less, right, left)
    cos, kept, total = np.zeros(len(left)), np.ones(len(left), bool), np.cumsum(size[left])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        x, y = left[at:to], right[at:to]
        pair, step = _ramp(size[x])
        e = begin[x][pair] + step
        asked = y[pair] * len(names) + local[e]
        place = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        hit = np.flatnonzero(key[place] == asked)
        e, place, pair = e[hit], place[hit], pair[hit]
        cos[at:to] = np.bincount(pair, w[e] * w[place], minlength=to - at)
        kept[at:to][pair[held[e] & held[place] & (local[e] < own[x][pair])]] = False
        at = to
    found = np.flatnonzero(kept & (cos >= t - SLACK))
    i, j = ids[left[found]], ids[right[found]]
    return pa.table({"j": pa.array(np.minimum(i, j), pa.int64()), "i": pa.array(np.maximum(i, j), pa.int64()), "cos": pa.array(cos[found])})


def _meetings(vectors: DataFrame, t: float) -> DataFrame:
    """``(id, d, lo, hi, side, entries, meeting)``: each vector once for each block that it meets in a dimension it holds."""
    dims = _shared(vectors)
    groups = (dims.agg(F.sum("df")).first()[0] or 0) // BUCKET + 1
    order = Window.partitionBy("id").orderBy(F.desc("df"), "d").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sqrt(F.sum(F.col("w") * F.col("w")).over(order)) >= t - 2 * SLACK
    near = vectors.join(dims, "dim").select("id", "d", "w", (held if t > SLACK else F.lit(True)).alias("held"), "df")
    rows = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d", "w", "held", "df"))).alias("e"))
    rows = rows.select("id", F.explode(F.expr("filter(e, x -> x.held)")).alias("h"), F.expr("transform(e, x -> struct(x.d, x.w, x.held))").alias("entries"))
    return dealt(rows.select("id", "h.d", F.expr(f"cast(h.df div {BLOCK} + 1 as int)").alias("blocks"), "entries"), ["d"], "id", groups)


def _joined(vectors: DataFrame, t: float) -> DataFrame:
    """As ``cosine_join``, for written vectors."""
    return _meetings(vectors, t).groupBy("meeting").applyInArrow(lambda table: _reached(table, t), "j long, i long, cos double")


def cosine_join(vectors: DataFrame, t: float) -> DataFrame:
    """``(j, i, cos)``, ``j < i``, for all pairs of normalised vectors whose product is at least ``t``.

    A threshold of 0 or less gives all pairs that share a dimension.
    """
    return _joined(written(vectors, "vectors"), t)


def _all_products(table: pa.Table, t: float) -> pa.Table:
    """The pairs of a meeting with a product of at least ``t``, among those that share a dimension."""
    left, right, two = _sides(table)
    out = []
    for at, rows, pieces in _postings(left, right):
        n = len(right.ids)
        cos, met = np.zeros(rows * n), np.zeros(rows * n, bool)
        for e, f, cell in pieces:
            cos += np.bincount(cell, left.entries["w"][e] * right.entries["w"][f], minlength=rows * n)
            met[cell] = True
        found = np.flatnonzero(met & (cos >= t - SLACK))
        i, j = left.ids[at + found // n], right.ids[found % n]
        kept = slice(None) if two else i < j
        out.append((np.minimum(i, j)[kept], np.maximum(i, j)[kept], cos[found][kept]))
    j, i, cos = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"j": pa.array(j, pa.int64()), "i": pa.array(i, pa.int64()), "cos": pa.array(cos, pa.float64())})


def cosine_join_bruteforce(vectors: DataFrame, t: float) -> DataFrame:
    """The same from all products, unpruned, block by block; with a threshold of 0 or less, all pairs of ids."""
    vectors = written(vectors, "vectors")
    rows = vectors.join(_shared(vectors), "dim").groupBy("id").agg(F.collect_list(F.struct("d", "w")).alias("entries"))
    met = _block_pairs(written(rows, "entries"))
    found = met.groupBy("pair").applyInArrow(lambda table: _all_products(table, t), "j long, i long, cos double")
    if t > SLACK:
        return found
    ids = vectors.select("id").distinct()
    pairs = ids.select(F.col("id").alias("j")).join(ids.select(F.col("id").alias("i")), F.col("j") < F.col("i"))
    return pairs.join(found, ["j", "i"], "left").select("j", "i", F.coalesce("cos", F.lit(0.0)).alias("cos"))


def _counted(table: pa.Table, t: float) -> pa.Table:
    """Candidates of a meeting: pairs of ``j < i`` that share a dimension that ``j`` holds. Survivors can still reach ``t``:
    with the product over such dimensions and, at most, the length of what ``j`` doesn't hold times that of ``i`` before the
    first of them."""
    candidates = survivors = 0
    left, right, two = _sides(table)
    rest = dict(zip(table.column("id").to_pylist(), table.column("rest").to_pylist()))
    for a, b in ((left, right), (right, left)) if two else ((left, right),):
        n = len(b.ids)
        more = np.array([rest[x] for x in a.ids.tolist()])
        for at, rows, pieces in _postings(a, b, backward=True):
            part, met, first = np.zeros(rows * n), np.zeros(rows * n, bool), np.zeros(rows * n)
            for e, f, cell in pieces:
                kept = np.flatnonzero(a.entries["held"][e] & (a.ids[a.row[e]] < b.ids[b.row[f]]))
                e, f, cell = e[kept], f[kept], cell[kept]
                part += np.bincount(cell, a.entries["w"][e] * b.entries["w"][f], minlength=rows * n)
                met[cell] = True
                first[cell] = b.entries["below"][f]  # the last that is put there stays: of the first dimension in the order
            found = np.flatnonzero(met)
            candidates += len(found)
            survivors += int((part[found] + more[at + found // n] * first[found] >= t - SLACK).sum())
    return pa.table({"candidates": pa.array([candidates], pa.int64()), "survivors": pa.array([survivors], pa.int64())})


def cosine_join_counts(vectors: DataFrame, t: float) -> DataFrame:
    """One row ``(candidates, survivors, pairs)``: what is left by an index of the dimensions that can lift a product to the
    threshold, by the bound on the rest, and by the exact product."""
    vectors = written(vectors, "vectors")
    met = _block_pairs(written(indexed(vectors, t), "indexed"))
    counted = met.groupBy("pair").applyInArrow(lambda table: _counted(table, t), "candidates long, survivors long")
    counted = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "survivors")])
    pairs = _joined(vectors, t).agg(F.count("*").alias("pairs"))
    return counted.withColumn("k", F.lit(1)).join(pairs.withColumn("k", F.lit(1)), "k").select("candidates", "survivors", "pairs")


def cosine_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(j, i, cos)`` of given pairs; 0.0 where they share no dimension."""
    left = vectors.select(F.col("id").alias("j"), "dim", F.col("w").alias("v"))
    right = vectors.select(F.col("id").alias("i"), "dim", "w")
    found = pairs.join(left, "j").join(right, ["i", "dim"]).groupBy("j", "i").agg(F.sum(F.col("v") * F.col("w")).alias("cos"))
    return pairs.join(found, ["j", "i"], "left").select("j", "i", F.coalesce("cos", F.lit(0.0)).alias("cos"))
