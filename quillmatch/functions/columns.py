"""Spark functions of string similarity. Bounds and counts are native; the exact ratio is an Arrow-batched function.

A null argument gives null.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import kernel


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _each(f, a: pd.Series, b: pd.Series, *rest: pd.Series) -> pd.Series:
    """``f`` over rows, null where an argument is null: once for each distinct row, and with one index for each ``b``.

    Rows are taken by ``b``, so that its index is made once in a batch and then let go.
    """
    rows = list(zip(b, a, *rest))
    by_row: dict = {}
    for k, row in enumerate(rows):
        by_row.setdefault(row, []).append(k)
    out: list = [None] * len(rows)
    whole = [row for row in by_row if not any(x is None for x in row)]
    whole.sort(key=lambda row: row[0])
    index = None
    for row in whole:
        if index is None or index.text != row[0]:
            index = kernel.Index(row[0])
        value = f(row[1], index, *row[2:])
        for k in by_row[row]:
            out[k] = value
    return pd.Series(out, dtype=object)


@pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(kernel.ratio, a, b)


@pandas_udf(T.DoubleType())
def _b2j(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(kernel.b2j_ratio, a, b)


@pandas_udf(T.DoubleType())
def _edge(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    return _each(kernel.edge, a, b, t)


@pandas_udf(T.BooleanType())
def _qualifies(a: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
    return _each(kernel.qualifies, a, b, t)


@pandas_udf(T.DoubleType())
def _capped(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
    return _each(kernel.ratio_capped, a, b, cap)


@pandas_udf(T.ArrayType(T.IntegerType()))
def _stats(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(lambda x, index: kernel.matching_stats(x, index.text), a, b)


def ratio(a, b) -> Column:
    """The exact ratio of ``a`` to ``b``; evaluated once however often the column is used."""
    return _once(_ratio)(_col(a), _col(b))


def b2j_ratio(a, b) -> Column:
    """The same number by the places of each character of ``b``, which suits texts with few meetings of equal characters."""
    return _once(_b2j)(_col(a), _col(b))


gestalt_ratio = gestalt_ratio_prebuilt = ratio


def edge(a, b, t: float, delta: float = 0.0) -> Column:
    """The ratio where it is at least ``t``, else null. ``delta`` would allow an approximation; it changes nothing."""
    return _once(_edge)(_col(a), _col(b), F.lit(float(t)))


def qualifies(a, b, t: float) -> Column:
    """Whether the ratio is at least ``t``; both answers are left early."""
    return _once(_qualifies)(_col(a), _col(b), F.lit(float(t)))


def ratio_capped(a, b, cap: float) -> Column:
    """The ratio where it is at most ``cap``, else 2.0, as soon as it is known to be above."""
    return _once(_capped)(_col(a), _col(b), F.lit(float(cap)))


def matching_stats(a, b) -> Column:
    """Lengths of the longest matches that end at each place of ``a``."""
    return _stats(_col(a), _col(b))


def matching_stats_cost(a, b) -> Column:
    """The sum of the matching statistics."""
    return F.aggregate(_once(_stats)(_col(a), _col(b)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def work_estimate(a, b) -> Column:
    """Meetings of equal characters of two strings, by which a matcher is chosen: native."""
    other = F.map_from_entries(char_counts(b))
    return F.aggregate(char_counts(a), F.lit(0).cast("long"), lambda acc, x: acc + x["n"].cast("long") * F.coalesce(F.try_element_at(other, x["c"]), F.lit(0)))


def _once(udf):
    return udf.asNondeterministic()


def real_quick_ratio(a, b) -> Column:
    """Upper bound of the ratio from the lengths alone."""
    n, m = F.length(_col(a)), F.length(_col(b))
    return F.when(n + m == 0, F.lit(1.0)).otherwise(2.0 * F.least(n, m) / F.nullif(n + m, F.lit(0)))


def char_counts(a) -> Column:
    """``array<struct<c, n>>``: the characters of a string with their counts, ascending.

    The characters are sorted once; a count is the distance between two places where the sorted characters change.
    """
    length = F.length(_col(a))
    chars = F.array_sort(F.split(_col(a), ""))
    first = F.filter(F.sequence(F.lit(1), length), lambda i: (i == 1) | (F.element_at(chars, i) != F.element_at(chars, F.greatest(i - 1, F.lit(1)))))
    behind = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(length + 1))
    made = F.zip_with(first, behind, lambda x, y: F.struct(F.element_at(chars, x).alias("c"), (y - x).alias("n")))
    return F.when(length == 0, F.array().cast("array<struct<c:string,n:int>>")).otherwise(made)


def quick_ratio(a, b) -> Column:
    """Upper bound of the ratio from the multisets of characters."""
    size = F.length(_col(a)) + F.length(_col(b))
    # what is left of b without the characters that a has, one for one, tells the size of the multisets' meet
    meet = F.aggregate(
        char_counts(a),
        F.lit(0),
        lambda acc, x: acc + F.least(x["n"], F.length(_col(b)) - F.length(F.replace(_col(b), x["c"], F.lit("")))).cast("int"),
    )
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * meet / F.nullif(size, F.lit(0)))


def ascii_profile(a) -> Column:
    """Counts of the 128 ASCII characters and, last, of all others."""
    counts = char_counts(a)
    held = F.map_from_entries(F.transform(F.filter(counts, lambda x: F.octet_length(x["c"]) == 1), lambda x: F.struct(F.ascii(x["c"]), x["n"])))
    ascii_ = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.coalesce(F.try_element_at(held, k), F.lit(0)))
    return F.concat(ascii_, F.array(F.length(_col(a)) - F.aggregate(ascii_, F.lit(0), lambda acc, x: acc + x)))


def delta_to_chain_cap(delta) -> Column:
    """The cap that an approximation of ``delta`` stands for."""
    d = _col(delta)
    return F.when(d <= 0, F.lit(2**32 - 1)).when(d >= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(1 / F.sqrt(F.greatest(d, F.lit(1e-300)))))).cast("long")


def register(spark: SparkSession) -> None:
    """Makes the Arrow-batched functions callable from SQL."""
    spark.udf.register("gestalt_ratio", _ratio)
    spark.udf.register("gestalt_edge", _edge)
    spark.udf.register("gestalt_qualifies", _qualifies)
    spark.udf.register("gestalt_ratio_capped", _capped)
    spark.udf.register("b2j_ratio", _b2j)
    spark.udf.register("matching_stats", _stats)
