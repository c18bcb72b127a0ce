"""quillmatch: exact text similarity, clustering and sparse-vector joins on Spark DataFrames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as _F

from .functions import columns as _columns
from .functions import kernel as _kernel
from .operators import cosine as _cosine
from .operators.cluster import cluster_canonicals, cluster_canonicals_lsh
from .operators.handles import CosineJoiner, Rationer, backend as _backend

__version__ = "0.2.0"
__all__ = ["ratio", "cluster_canonicals", "cluster_canonicals_lsh", "Rationer", "cosine_join", "CosineJoiner"]


def ratio(a: str | Column | DataFrame, b: str | Column | None = None, *, threads: int = 0):
    """The exact ratio: of two Python strings a float, of two Columns a Column, of a DataFrame ``(a, b)`` the DataFrame with ``ratio``."""
    if b is None:
        return Rationer(threads=threads or None).ratio_many(a)
    if isinstance(a, str) and isinstance(b, str):
        return _kernel.ratio(a, b)
    return _columns.ratio(a, b)


def cosine_join(docs: DataFrame, t: float, idx: str = "id", tokens: str | Column = "tokens", concurrency: str = "cpu") -> DataFrame:
    """``(j, i, cos)``, ``j < i``, of all documents whose TF-IDF vectors have a cosine of at least ``t``."""
    _backend(concurrency)
    column = _F.col(tokens) if isinstance(tokens, str) else tokens
    return _cosine.cosine_join(_cosine.normalised(_cosine.tfidf(docs, idx, _cosine.short_names(column))), t)
