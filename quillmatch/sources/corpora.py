"""Readers of the corpus formats, and a generator of skewed sparse vectors for tests and benchmarks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first eight bytes of a sparse-row file, as a little-endian number: a fixed value.
SPARSE_MAGIC = 0x53494D4A4F494E31


def from_list(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``(idx, text)`` of a Python list: ``idx`` is the place in the list."""
    table = pa.table({"idx": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    return spark.createDataFrame(table) if texts else spark.createDataFrame([], "idx long, text string")


def read_nul_separated(spark: SparkSession, path: str, limit: int | None = None, errors: str = "replace", sample: int | None = None, seed: int = 13) -> DataFrame:
    """``text`` of every entry that is not empty, of files in which NUL bytes part the entries.

    ``errors``: ``replace`` puts U+FFFD in place of bytes that are no UTF-8, ``surrogatepass`` keeps them as they are, so
    that an encoded surrogate counts as one character. ``limit`` takes some entries; ``sample`` takes a fixed random sample
    of so many, the first by a digest of ``seed`` and text.
    """
    if errors not in ("replace", "surrogatepass"):
        raise ValueError(f"errors must be replace or surrogatepass, not {errors!r}")
    value = F.make_valid_utf8("value") if errors == "replace" else F.col("value")
    rows = spark.read.text(path, lineSep="\0").where("octet_length(value) > 0").select(value.alias("text"))
    if sample is not None:
        rows = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("text")).cast("binary")), "text").limit(sample)
    return rows if limit is None else rows.limit(limit)


def write_nul_separated(df: DataFrame, path: str, text: str = "text") -> None:
    """Writes the texts of ``df`` in that form; a text must not have a NUL itself. Null texts are left out."""
    df.select(text).where(F.col(text).isNotNull()).write.option("lineSep", "\0").text(path)


def read_sparse_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(file, id, dim, w)`` of binary sparse-row files.

    A header of 16 bytes (magic, number of rows, 4 unused) precedes the rows; a row is its number of entries and the
    entries, each a 32-bit dimension and a 32-bit float. A file without the magic raises an error. One task reads a file,
    entry by entry of the format, so large corpora should come in many files.
    """

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                magic, n = struct.unpack_from("<QI", raw)
                if magic != SPARSE_MAGIC:
                    raise ValueError(f"{name}: not a sparse-row file")
                at, ids, dims, weights = 16, [], [], []
                for k in range(n):
                    (size,) = struct.unpack_from("<I", raw, at)
                    entries = np.frombuffer(raw, np.dtype([("d", "<u4"), ("w", "<f4")]), size, at + 4)
                    ids.append(np.full(size, k, np.int64))
                    dims.append(entries["d"].astype(np.int64))
                    weights.append(entries["w"].astype(np.float64))
                    at += 4 + 8 * size
                    if len(ids) == 10_000 or k == n - 1:
                        i = np.concatenate(ids)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i), pa.array(np.concatenate(dims)), pa.array(np.concatenate(weights))], names=["file", "id", "dim", "w"])
                        ids, dims, weights = [], [], []

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, id long, dim long, w double")


def write_sparse_file(spark: SparkSession, rows: list[list[tuple[int, float]]], path: str) -> None:
    """Writes one such file from rows on the driver, to any file system that Spark knows: for small fixtures."""
    raw = struct.pack("<QII", SPARSE_MAGIC, len(rows), 0) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<If", d, w) for d, w in r) for r in rows)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


#: The Mersenne prime 2^31 - 1 and two of its primitive roots, of public congruential generators: fixed values.
MERSENNE, ROOTS = 2147483647, (48271, 16807)


def zipf_rows(spark: SparkSession, n: int, nnz: int = 14, dims: int = 20_000, copies: float = 0.05, seed: int = 1) -> DataFrame:
    """``(id, dim, w)``: ``n`` skewed sparse rows; a share of them differ from the row before in one entry.

    Dimensions are the cubes of even draws, so low ones are frequent; a weight grows with its dimension's rarity. A draw is
    a congruential one from the row's number and the entry's, so it is the same in every partition and system.
    """
    entries = spark.range(n).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nnz - 1).cast("long"))).alias("k"))

    def draw(a, b):
        x = (a * 1000003 + b * 7919 + seed * 104729 + 12345) % MERSENNE
        for root in ROOTS * 2:
            x = (x * root + a + b) % MERSENNE
        return (x + 0.5) / MERSENNE

    copied = draw(F.col("id"), F.lit(nnz).cast("long")) < copies
    like = F.when(copied & (F.col("k") > 0), F.col("id") - 1).otherwise(F.col("id"))
    u = draw(like, F.col("k"))
    dim = F.floor(u * u * u * dims)
    return entries.select("id", dim.cast("long").alias("dim"), F.log(2.0 + dim / 50).alias("w"))
