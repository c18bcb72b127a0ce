"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of ``block_docs`` documents. Of a source with target weight ``w``, block ``j`` has the
release time ``floor(j / w)`` and the deadline ``ceil((j + 1) / w)``; one block runs in each slot, the released one with
the earliest deadline. At every slot ``t`` each source that still has blocks has had less than one block more or less
than ``w * t``. Times are computed in whole numbers from the weights as given, so this holds over schedules of any length.

Executors rank the documents and join them to the table of slots. The driver orders the blocks, never documents: it holds
a few numbers for each source, and writes the slots to the shared folder in pieces of ``PIECE`` blocks.

Every document is scheduled exactly once: none is dropped or repeated. When a source has run out its slots may stay empty,
so the others go on in their proportions. Without given weights a source weighs as its number of documents to the
power ``alpha``; 0.5 favours small sources.

Defined results: a null source is a source of its own; a float weight stands for the shortest decimal that reads as it;
sources without a given weight, or with weight 0, follow when all others have run out, weighted among themselves as
without given weights; equal documents are scheduled each on its own, ranked among themselves arbitrarily but never onto
one place; an empty table gives an empty result; further columns are carried along, whatever their names, but one named as
an added column gives way to it; very long texts are rows like others; a slot beyond 2^63 raises OverflowError.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.plans.storage import fresh_path, written

from .kernel import carried

#: Blocks whose slots the driver holds before it writes them.
PIECE = 1 << 20
#: Tables of at most so many rows are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 1 << 20


def whole_weights(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    known = {w: Fraction(w) if isinstance(w, (int, Fraction)) else Fraction(repr(float(w))) for w in set(weights)}
    if any(w < 0 for w in known.values()) or not any(known.values()):
        raise ValueError("weights must not be negative, and one at least above 0")
    scale = math.lcm(*(w.denominator for w in known.values()))
    whole = {w: int(x * scale) for w, x in known.items()}
    return [whole[w] for w in weights]


def in_slots(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(source, block, slot)`` for all ``blocks[k]`` blocks of each source ``k``, in the order of the slots.

    Earliest deadline first among the released; ties go to the earlier source. The shares of all sources fill the slots
    exactly, so a schedule that meets all deadlines exists, and this order finds it.
    """
    total, n = sum(weights), len(weights)
    had, slot = array("q", bytes(8 * n)), 0
    # entries are time * n + source: one for each source, in one of the two
    ready = sorted(-(-total // w) * n + k for k, w in enumerate(weights))
    waiting: list[int] = []
    while ready or waiting:
        if not ready:
            slot = max(slot, waiting[0] // n)
        while waiting and waiting[0] // n <= slot:
            k = heappop(waiting) % n
            heappush(ready, -(-(had[k] + 1) * total // weights[k]) * n + k)
        k = heappop(ready) % n
        block = had[k]
        yield k, block, slot
        slot += 1
        had[k] = block + 1
        if block + 1 < blocks[k]:
            heappush(waiting, (block + 1) * total // weights[k] * n + k)


def all_in_slots(weights: list[int], blocks: list[int], later: list[int]) -> Iterator[tuple[int, int, int]]:
    """As ``in_slots``; sources of weight 0 follow when the others have run out, by their weights in ``later``."""
    first = 0
    for of, some in ((weights, [k for k, w in enumerate(weights) if w]), (later, [k for k, w in enumerate(weights) if not w])):
        last = first - 1
        for k, block, slot in in_slots([of[k] for k in some], [blocks[k] for k in some]):
            last = first + slot
            yield some[k], block, last
        first = last + 1


def pieces(placed: Iterator[tuple[int, int, int]]) -> Iterator[np.ndarray]:
    """The rows in arrays of at most ``PIECE`` rows."""
    flat = array("q")
    for row in placed:
        flat.extend(row)
        if len(flat) >= 3 * PIECE:
            yield np.array(flat, np.int64).reshape(-1, 3)
            flat = array("q")
    if flat:
        yield np.array(flat, np.int64).reshape(-1, 3)


def slot_table(spark, placed: Iterator[tuple[int, int, int]], numbers: np.ndarray) -> tuple[DataFrame, int]:
    """``(_source_no, _turn, slot)``, written in the shared folder, and the number of its rows."""
    path, n = fresh_path(spark, "slots"), 0
    for rows in pieces(placed):
        columns = [numbers[rows[:, 0]], rows[:, 1], rows[:, 2]]
        part = pa.table([pa.array(c) for c in columns], names=["_source_no", "_turn", "slot"])
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
        n += len(rows)
    return spark.read.schema("_source_no long, _turn long, slot long").parquet(path), n


def period_table(spark, shares: list[int]) -> DataFrame:
    """``(source_no, turn, at)``: the slots of a schedule in which source ``k`` has ``shares[k]`` blocks and that weight."""
    table, _ = slot_table(spark, in_slots(shares, shares), np.arange(len(shares)))
    return table.toDF("source_no", "turn", "at")


def schedule(
    docs: DataFrame, source: str | Column = "source", order: str | Column = "doc_id", weights: dict | None = None, block_docs: int = 16,
    alpha: float = 0.5, salts: int = 1024,
) -> DataFrame:
    """All of ``docs`` with ``block``, ``slot`` and ``place``, the document's place in its block.

    Documents of a source are ranked by a hash of ``order``, which shuffles them, and then by ``order``. The ranking runs
    within ``salts`` divisions of each source, so no source, however large, has to pass through one task.
    """
    spark = docs.sparkSession
    name = (F.col(source) if isinstance(source, str) else source).cast("string")
    base = docs.select(
        F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("_source"),
        (F.col(order) if isinstance(order, str) else order).alias("_order"),
        F.struct(*[docs[c] for c in docs.columns]).alias("_row"),
    ).withColumn("_salt", F.pmod(F.xxhash64("_order", F.lit(7)), F.lit(salts)))
    sizes = written(base.groupBy("_source", "_salt").count(), "sizes")
    totals = sizes.groupBy("_source").agg(F.sum("count").alias("_n")).orderBy("_source")
    sources = written(totals.withColumn("_no", F.monotonically_increasing_id()), "sources")
    held = sources.select("_no", "_n", *(["_source"] if weights is not None else [])).toArrow().sort_by("_no")
    numbers, counts = (held[c].to_numpy() for c in ("_no", "_n"))
    if not len(counts):
        none = F.lit(None).cast("long")
        return docs.select(*carried(tuple(docs.columns), ("block", "slot", "place")), none.alias("block"), none.alias("slot"), none.alias("place"))
    later = whole_weights([float(n) ** alpha for n in counts.tolist()])
    given = later
    if weights is not None:
        given = whole_weights([weights.get(s[1:] if s[0] == "s" else None, 0) for s in held["_source"].to_pylist()])
    slots, n_blocks = slot_table(spark, all_in_slots(given, (-(-counts // block_docs)).tolist(), later), numbers)
    before = Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = sizes.select("_source", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")).join(
        sources.select("_source", "_no"), "_source"
    )
    if len(counts) * salts <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    if n_blocks <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    within = Window.partitionBy("_source", "_salt").orderBy("_order")
    ranked = (
        base.withColumn("_rank", F.row_number().over(within))
        .join(cells, ["_source", "_salt"])
        .select("_row", "_no", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
        .withColumn("block", F.expr(f"_rank div {block_docs}"))
    )
    placed = ranked.join(slots, (F.col("_no") == F.col("_source_no")) & (F.col("block") == F.col("_turn")))
    own = [F.col("_row").getField(c).alias(c) for c in carried(tuple(docs.columns), ("block", "slot", "place"))]
    return placed.select(*own, "block", "slot", F.expr(f"_rank % {block_docs}").alias("place"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """All of ``docs`` with its own columns only, dealt and sorted so that written files follow the schedule."""
    columns = docs.columns
    boxed = docs.select(F.struct(*[docs[c] for c in columns]).alias("_doc"))
    source, order = options.pop("source", "source"), options.pop("order", "doc_id")
    timed = schedule(boxed, source=F.col(f"_doc.{source}"), order=F.col(f"_doc.{order}"), **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return timed.repartitionByRange(n, "slot", "place").sortWithinPartitions("slot", "place").select("_doc.*")
