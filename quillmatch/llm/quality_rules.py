"""Quality rules: a table of thresholds compiled into one Spark projection, with no user functions.

``score(docs)`` adds the counts and ratios; ``RULES`` is the threshold table, and ``compile_rules`` turns any such
table into one boolean column. Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r``.

Defined results: a null text counts as empty, which has no words and fails the base; rows with a null id or with an
id that occurs again are judged each on its own; an empty table gives an empty result; further columns of the
input are carried along when asked for with ``keep``, whatever their names; one named as an added column gives way to it.
Texts of any length are judged whole. The 8-word windows of a text are told apart by 64-bit hashes within that text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import carried

WINDOW = 8

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he or are this at from "
    "le la les de des du un une et que qui dans en pour est pas sur au "
    "der die das und ist von zu den mit sich auf ein eine nicht "
    "el los las que y en un una por con para es se del no su"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= metric <= high``; a missing bound doesn't bind."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios are in hundredths, of words, of characters in words or of lines.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("repeats", "repeat_pct", None, 30),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_pct", None, 10),
    Rule("stop_words", "stop_pct", 2, None),
    Rule("duplicate_lines", "dup_line_pct", None, 50),
)


def compile_rules(rules=RULES) -> Column:
    """One boolean column: every rule of the table holds."""
    held = F.lit(True)
    for r in rules:
        if r.low is not None:
            held = held & (F.col(r.metric) >= F.lit(r.low))
        if r.high is not None:
            held = held & (F.col(r.metric) <= F.lit(r.high))
    return held


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(hashes: str) -> str:
    """SQL: words within windows that occur twice or more; ``hashes`` holds the windows' by their first word."""
    by_hash = f"sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))"
    starts = (
        "sort_array(transform(filter(m, (x, k) -> (k > 0 and m[k - 1].h = x.h) "
        "or (k < size(m) - 1 and m[k + 1].h = x.h)), x -> x.i))"
    )
    covered = (
        "aggregate(p, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct("
        f"'n', a.n + (i + {WINDOW}) - greatest(i, a.end), 'end', i + {WINDOW}), a -> a.n)"
    )
    return (
        f"case when size({hashes}) = size(array_distinct({hashes})) then 0L "
        f"else {_let('m', by_hash, _let('p', starts, covered))} end"
    )


def score(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules=RULES) -> DataFrame:
    """``keep`` and, for every text: the counts, the ratios, ``base_failed`` and ``kept``."""
    base = docs.select(F.struct(*[docs[c] for c in keep]).alias("_keep"), F.coalesce(docs[text], F.lit("")).alias("_t"))
    counted = base.select(
        "_keep",
        F.expr(r"array_remove(split(_t, '[ \\t-\\r]+'), '')").alias("_w"),
        F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^ \\t-\\r]')").alias("_l"),
        F.expr(r"cast(length(_t) - regexp_count(_t, '[ \\t-\\r]') as long)").alias("word_chars"),
        F.expr(r"cast(regexp_count(_t, '[#*$%&|<>]') as long)").alias("n_symbols"),
    )
    # Hashes of 2, 4 and then 8 words, each from two of the half length; the last ones run over the end.
    hashed = counted.withColumn("_h", F.expr("zip_with(_w, slice(_w, 2, size(_w)), (a, b) -> xxhash64(a, b))"))
    for half in (2, 4):
        hashed = hashed.withColumn("_h", F.expr(f"zip_with(_h, slice(_h, {half + 1}, size(_h)), (a, b) -> xxhash64(a, b))"))
    hashed = hashed.withColumn("_h", F.expr(f"slice(_h, 1, greatest(size(_w) - {WINDOW - 1}, 0))"))
    stops = ", ".join(f"'{f(w)}'" for w in dict.fromkeys(STOP_WORDS) for f in (str.lower, str.capitalize, str.upper))
    out = hashed.select(
        "_keep",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"),
        F.expr(_repeat_words("_h")).alias("n_repeat_words"),
        F.expr(f"cast(size(filter(_w, w -> w in ({stops}))) as long)").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    out = out.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (100 * F.col("n_symbols") / chars).alias("symbol_pct"),
        (100 * F.col("n_stop_words") / words).alias("stop_pct"),
        (100 * F.col("n_dup_lines") / lines).alias("dup_line_pct"),
        (100 * F.col("n_repeat_words") / words).alias("repeat_pct"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    out = out.select("*", (~F.col("base_failed") & compile_rules(rules)).alias("kept"))
    own = out.columns[1:]
    return out.select(*[F.col("_keep").getField(c).alias(c) for c in carried(keep, own)], *own)
