"""Handles that keep a prepared corpus, with the options of a single-machine library: none of them changes a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions import columns
from quillmatch.plans.storage import written

from . import cluster, cosine

# The names that callers of such handles may give.
BACKENDS = ("cpu", "gpu", "gpu+cpu", "gpucpu", "gpu_cpu")


def backend(name: str) -> str:
    """Accepts the known names in any case; Spark's executors do the work whatever is asked for."""
    if name.lower() not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}")
    return "cpu"


class Rationer:
    """Ratios and clusters; ``threads`` is the number of partitions that ratios are dealt to."""

    def __init__(self, concurrency: str = "gpu+cpu", threads: int | None = None, delta: float = 0.0):
        self.concurrency = backend(concurrency)
        self.threads = threads
        self.delta = min(1.0, max(0.0, delta))

    def ratio(self, a: str | Column, b: str | Column) -> Column:
        return columns.ratio(a, b)

    def edge(self, a: str | Column, b: str | Column, t: float) -> Column:
        """The ratio where it is at least ``t``, else null: exact whatever ``delta`` is."""
        return columns.edge(a, b, t, self.delta)

    def ratio_many(self, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
        """``pairs`` with ``ratio``: dealt and sorted by ``b``, so that each ``b`` is indexed once and equal pairs are scored
        once; the columns of ``pairs`` tell rows apart, which come in no order."""
        n = self.threads or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return pairs.repartition(n, b, a).sortWithinPartitions(b, a).withColumn("ratio", columns.ratio(a, b))

    def prepare(self, corpus: DataFrame, idx: str = "idx", text: str = "text") -> PreparedRationer:
        return PreparedRationer(corpus.select(F.col(idx).cast("long").alias("idx"), F.col(text).alias("text")))

    def cluster_canonicals(self, corpus: DataFrame, idx: str = "idx", text: str = "text", t: float = 0.8) -> DataFrame:
        return cluster.cluster_canonicals(corpus, idx, text, t)

    def cluster_canonicals_multi(self, corpus: DataFrame, group: str, idx: str = "idx", text: str = "text", t: float = 0.8) -> DataFrame:
        return cluster.cluster_canonicals_multi(corpus, group, idx, text, t)


class PreparedRationer:
    """A corpus ``(idx, text)``, written once, whose rows are scored by their ids."""

    def __init__(self, corpus: DataFrame):
        self.corpus = written(corpus, "corpus")

    def __len__(self) -> int:
        return self.corpus.count()

    def is_empty(self) -> bool:
        return self.corpus.isEmpty()

    def ratio_many_idx(self, pairs: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
        """``pairs`` with ``ratio``; raises IndexError if an id is not in the corpus."""
        asked = pairs.select(F.explode(F.array(i, j)).alias("idx")).distinct()
        if not asked.join(self.corpus, "idx", "left_anti").isEmpty():
            raise IndexError("a pair names an id that the corpus doesn't have")
        p = self.corpus.select(F.col("idx").alias(i), F.col("text").alias("_a"))
        q = self.corpus.select(F.col("idx").alias(j), F.col("text").alias("_b"))
        return pairs.join(p, i).join(q, j).withColumn("ratio", columns.ratio("_a", "_b")).drop("_a", "_b")


class CosineJoiner:
    """Vectors prepared once and joined at any threshold."""

    has_gpu = False

    def __init__(self, vectors: DataFrame):
        self.corpus = written(vectors, "vectors")

    @classmethod
    def from_token_docs(cls, docs: DataFrame, idx: str, tokens: Column) -> CosineJoiner:
        return cls(cosine.normalised(cosine.tfidf(docs, idx, cosine.short_names(tokens))))

    @classmethod
    def from_rows(cls, rows: DataFrame) -> CosineJoiner:
        return cls(cosine.normalised(rows))

    def join(self, t: float, concurrency: str = "cpu") -> DataFrame:
        backend(concurrency)
        return cosine._joined(self.corpus, t)
