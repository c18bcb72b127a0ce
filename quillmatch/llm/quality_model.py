"""A quality classifier made of sparse rules over text statistics, scored by Spark columns alone.

Boosted shallow trees are grown on the statistics of a sample; each path from a root is a conjunctive rule; a logistic
model with an absolute penalty keeps the few rules that matter; these are compiled into one column expression.

The model is fitted on at most about ``SAMPLE`` labelled rows, taken by a hash of their id; scoring has no bound.

Defined results: null and empty texts are scored as texts without words; null ids and rows without a label are scored but
not learned from; rows of one id are scored each on its own; without labelled rows of both kinds the score is the share of
ones (1.0 if there are none at all); an empty table gives an empty result; further columns are left out unless asked for
with ``keep``, where one named as an added column gives way to it. Very long texts are scored whole, their words in one array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import carried
from .language_id import held_out_row
from .linear import lasso

SAMPLE = 20_000

#: Statistics as SQL over ``t`` (the text), ``n`` (its characters, at least 1), ``w`` (words), ``m`` (their number, at least 1).
STATISTICS = {
    "log_words": "ln(m)",
    "word_chars": r"(n - regexp_count(t, '\\s')) / m",
    "symbols": r"regexp_count(t, '[#*$%&<>@^~=+_]') / n",
    "bars": r"regexp_count(t, '[|]') / m",
    "exclaims": r"regexp_count(t, '!') / m",
    "capitals": r"regexp_count(t, '\\p{Lu}') / n",
    "digits": r"regexp_count(t, '[0-9]') / n",
    "stops": r"regexp_count(t, '[.,;:?]') / m",
    "lines": r"(1 + regexp_count(t, '\n')) / m",
    "links": r"regexp_count(t, 'https?:|www[.]') / m",
    "distinct": "size(array_distinct(w)) / m",
    "echoes": "size(filter(zip_with(w, slice(w, 2, size(w)), (a, b) -> a = b), x -> x)) / m",
    "repeated_pairs": "1 - size(array_distinct(zip_with(w, slice(w, 2, size(w)), (a, b) -> xxhash64(a, b)))) / m",
}


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and one DOUBLE column for each statistic, whose names begin with ``_s_``."""
    row = F.struct(*[docs[c] for c in keep]).alias("_row")
    base = docs.select(row, F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("_row", "t", F.greatest(F.length("t"), F.lit(1)).alias("n"), F.expr(r"array_remove(split(t, '\\s+'), '')").alias("w"))
    base = base.select("_row", "t", "n", "w", F.greatest(F.size("w"), F.lit(1)).alias("m"))
    return base.select("_row.*", *[F.expr(f"cast({e} as double)").alias(f"_s_{name}") for name, e in STATISTICS.items()])


@dataclass(frozen=True)
class Rule:
    """A conjunction: ``(statistic, above, threshold)`` means ``statistic > threshold``, or ``<=`` if not ``above``."""

    conditions: tuple[tuple[str, bool, float], ...]

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = True
        for name, above, at in self.conditions:
            out = out & ((table[name] > at) if above else (table[name] <= at))
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.conditions:
            out = out & ((F.col(f"_s_{name}") > at) if above else (F.col(f"_s_{name}") <= at))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score, 0 to 1, over the columns of ``statistics``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def _grow(x: np.ndarray, names: list[str], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, least: int):
    """Splits ``rows`` where a second-order gain is largest; ``out`` gets (path, rows, value) of the leaves."""
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for k in range(x.shape[1]):
            order = rows[np.argsort(x[rows, k], kind="stable")]
            v, gs, hs = x[order, k], np.cumsum(gradient[order]), np.cumsum(weight[order])
            cut = np.flatnonzero(v[:-1] < v[1:])
            cut = cut[(cut >= least - 1) & (cut < len(order) - least)]
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + 1) + (g - gs[cut]) ** 2 / (h - hs[cut] + 1) - g * g / (h + 1)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], k, float((v[cut[j]] + v[cut[j] + 1]) / 2))
    if best[1] is None:
        out.append((path, rows, -g / (h + 1)))
        return
    _, k, at = best
    for above in (False, True):
        part = rows[(x[rows, k] > at) == above]
        _grow(x, names, gradient, weight, part, depth - 1, (*path, (names[k], above, at)), out, least)


def fit_rules(table: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 3.0, least: int = 10, rate: float = 0.4) -> RuleModel:
    """Rules and weights for labels ``y`` (0 or 1); deterministic."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 1.0, 1e-9, 1 - 1e-9))
        return RuleModel(float(np.log(share / (1 - share))), ())
    names = list(table)
    x = np.column_stack([table[n] for n in names])
    logit = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        leaves: list = []
        _grow(x, names, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, (), leaves, least)
        for path, rows, value in leaves:
            logit[rows] += rate * value
            for k in range(1, len(path) + 1):
                rules[Rule(path[:k])] = None
    found = list(rules)
    if not found:
        share = y.mean()
        return RuleModel(float(np.log(share / (1 - share))), ())
    held = np.column_stack([r.holds(table) for r in found]).astype(float)
    w = lasso(held, y, penalty)
    return RuleModel(float(w[0]), tuple((r, float(c)) for r, c in zip(found, w[1:]) if abs(c) > 1e-6))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, y)``: about ``sample`` labelled rows that aren't held out, by a hash of the id.

    An id with several labels takes the largest. The sample's ids are broadcast; their number is bounded by ``sample``.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out_row(5, 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > sample:
        known = known.where(F.xxhash64("doc_id", F.lit(5)) % 1_000_003 < F.lit(int(2_000_006 * sample / n) - 1_000_003))
    return docs.select("doc_id", "text").join(F.broadcast(known.limit(2 * sample)), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """The model learned from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``."""
    rows = statistics(labelled(docs, labels, label, sample), keep=("doc_id", "y")).toPandas().sort_values(["doc_id", *[f"_s_{n}" for n in STATISTICS]])
    table = {n: rows[f"_s_{n}"].to_numpy(np.float64) for n in STATISTICS}
    return fit_rules(table, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``held_out``, ``score`` and ``predicted`` for every text of ``docs(doc_id, text)``."""
    keep = carried(keep, ("held_out", "score", "predicted"))
    boxed = docs.select(F.struct(*[docs[c] for c in keep]).alias("_keep"), held_out_row(5, 0).alias("held_out"), "text")
    scored = statistics(boxed, keep=("_keep", "held_out")).select("_keep", "held_out", model.column().alias("score"))
    return scored.select("_keep.*", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with their own columns."""
    boxed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col("doc_id"), F.col("text"))
    return score(boxed, model, threshold, ("_doc",)).where("predicted = 1").select("_doc.*")
