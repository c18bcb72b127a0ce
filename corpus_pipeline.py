"""A corpus pipeline of five stages; each works on all that the one before it kept.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet in the session's shared folder and reads them again as the next one's input.

Defined results, as in the operators: a null text is an empty one, which the classifier may reject and no later stage does;
rows with a null id are never learned from, never removed as copies and never cut; rows of one id are judged each by its own
text, but cut as one document; equal rows stay or go together; null languages, sources and sizes pass through (a null source
is one of its own); an empty table gives an empty one with the same columns at every stage; very long texts pass whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import bpe, mixing, ngram_join, quality_model, substrings
from quillmatch.plans.storage import written

#: SQL cannot express the fitted classifier; a brute-force test stands in for it.
ORACLE_SQL = None


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id."""
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that a document with a smaller id has too."""
    return substrings.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow the schedule of their sources."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of each document's ids and of its text decoded from them."""
    return bpe.round_trip(docs, _vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
