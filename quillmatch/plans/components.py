"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with a map-side combine followed by an equi-join on the node, so a node with very
many edges is combined before the shuffle and the join's partition can be split by adaptive execution. The
number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that occurs in an edge; ``component`` is its least reachable node.

    Loops and rows with a null end are ignored and repeated or reversed edges change nothing; an empty edge
    table gives an empty result. Raises if the labels have not settled after ``max_rounds`` rounds.
    """
    start = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    with Scratch(edges.sparkSession) as tmp:
        now = tmp.written(_small_star(start), "components")
        seen = None
        for _ in range(max_rounds):
            # A star forest: every node points at its component's least node, and no such node points elsewhere.
            state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if state == seen or state[0] == 0:
                tmp.keep_last()
                return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                    now.select(F.col("v").alias("node"), F.col("v").alias("component"))
                ).distinct()
            seen = state
            now = tmp.written(_small_star(_large_star(now)), "components")
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
