"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

``write`` deals the documents by ranges of their id, so file names ascend with the ids they hold, and encodes them where
they were dealt; each row holds a document's id, its number of ids, its ids and its place within the file. Stripes can be
read in parallel, and a search for a document opens only the files, stripes and row groups that can hold it.
``positions`` reads the files back.

Defined results: null and empty texts have the end id alone; null document ids come first and documents of one id come in
the order of their texts; an empty table makes files without rows; further columns of the input aren't written; a very long
text is one row, of four bytes for each id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.plans.batches import small_batches

from .bpe import texts_of, vocabulary

SCHEMA = "doc_id long, n_tokens long, offset long, ids array<int>"
OPTIONS = {
    "orc.compress": "ZSTD",
    "orc.stripe.size": str(32 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Writes the ids of every document of ``docs(doc_id, text)``, each with ``end_id`` behind it, below ``path``."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, "doc_id")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        vocab, place = vocabulary(vocab_path), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = [vocab.encode(raw) + end for raw in texts_of(part.column(1))]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(place + bounds[:-1]), lists], names=["doc_id", "n_tokens", "offset", "ids"])
                place += int(bounds[-1])

    rows = dealt.sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
    with small_batches(spark):
        rows.write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with the number of the file in ``part``."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("part"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files."""
    rows = read(spark, path)
    # One row for each file: what stands before it. Only the column of counts is read.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), batch.column(4)], names=["doc_id", "offset", "n_tokens", "ids_crc32", "part"])

    checked = rows.select("doc_id", "offset", "n_tokens", "ids", "part").mapInArrow(run, "doc_id long, offset long, n_tokens long, ids_crc32 long, part int")
    return checked.join(before, "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
