"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from quillmatch.plans.storage import fresh_path, written

from . import bpe, language_id, mixing, ngram_join, quality_model, quality_rules, simhash, substrings, token_files, toxicity


def vocabulary_path() -> str:
    """The production vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality_rules.score(_docs(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_toxicity(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def op3_ngram_join(spark, sf_dir):
    return ngram_join.classes(_docs(spark, sf_dir))


def op8_substrings(spark, sf_dir):
    return substrings.digest(_docs(spark, sf_dir))


def op4_simhash(spark, sf_dir):
    """Besides the fingerprints: of each document whose id 50 divides, how many others are near copies by their fingerprints."""
    prints = written(simhash.edited(_docs(spark, sf_dir)), "fingerprints")
    found = simhash.near_counts(prints.where("doc_id % 50 = 0"), prints).toDF("fingerprint", "_n")
    return prints.join(found, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(F.col("doc_id") % 50 == 0, F.col("_n") - 1).alias("n_near"),
    )


def op5_language_id(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out_row(3, 1))
    return language_id.learn_and_identify(docs, ~F.col("held_out"), ("doc_id", "held_out"))


def op6_quality_model(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    return quality_model.score(docs, quality_model.fit(docs, _labels(spark, sf_dir)))


def op7_bpe_chunks(spark, sf_dir):
    return bpe.round_trip(_docs(spark, sf_dir), vocabulary_path())


def op9_token_orc(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    token_files.write(_docs(spark, sf_dir), path, vocabulary_path())
    return token_files.positions(spark, path)


def op10_pfair_mixing(spark, sf_dir):
    return mixing.schedule(_docs(spark, sf_dir).select("doc_id", "source"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_join": op3_ngram_join,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_quality_model": op6_quality_model,
    "op7_bpe_chunks": op7_bpe_chunks,
    "op8_substrings": op8_substrings,
    "op9_token_orc": op9_token_orc,
    "op10_pfair_mixing": op10_pfair_mixing,
    "pipeline": corpus_pipeline.run,
}


def _op1_sql() -> str:
    checks = " AND ".join(
        f"{r.metric} {sign} {bound}"
        for r in quality_rules.RULES
        for sign, bound in ((">=", r.low), ("<=", r.high))
        if bound is not None
    )
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    forms = f"list_contains([{stops}], lower(x)) AND (x = lower(x) OR x = upper(x) OR x = upper(x[1]) || lower(x[2:]))"
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
 win AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) i FROM w)),
 twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM win) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 8)) p FROM twice) GROUP BY doc_id),
 li AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls FROM w),
 base AS (SELECT w.doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
   coalesce(rep.n, 0)::BIGINT n_repeat_words, len(list_filter(ws, lambda x: {forms}))::BIGINT n_stop_words, len(ls)::BIGINT n_lines
   FROM w JOIN li USING (doc_id) LEFT JOIN rep USING (doc_id)),
 r AS (SELECT *, word_chars / greatest(n_words, 1) mean_word_chars, 100 * n_symbols / greatest(word_chars, 1) symbol_pct,
   100 * n_stop_words / greatest(n_words, 1) stop_pct, 100 * n_dup_lines / greatest(n_lines, 1) dup_line_pct,
   100 * n_repeat_words / greatest(n_words, 1) repeat_pct,
   n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {checks} kept FROM r"""


_OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
 s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
   SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) g FROM w WHERE len(ws) >= 5
   UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
 u AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
 r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
 JOIN (SELECT x doc_id, min(y) component_id FROM r GROUP BY x) c USING (doc_id)"""

_OP8_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
 win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) i FROM w)),
 late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) low FROM win) WHERE low < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM late),
 words AS (SELECT doc_id, unnest(ws) word, unnest(range(1, len(ws) + 1)) p FROM w),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) t, count(*) n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT n_words, (len(ws) - coalesce(kept.n, 0))::BIGINT n_removed, sha256(coalesce(kept.t, '')) kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def oracle() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op3_ngram_join": _OP3_SQL, "op8_substrings": _OP8_SQL}
