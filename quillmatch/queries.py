"""The registered queries of the similarity operators, each over its whole table, with DuckDB SQL for their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.functions import columns
from quillmatch.operators import cluster, cosine, lsh, pairs
from quillmatch.operators.handles import BACKENDS, CosineJoiner, Rationer, backend
from quillmatch.plans.storage import fresh_path
from quillmatch.sources import corpora


def _lines():
    return F.split(F.col("text"), "\n")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_name").where("p_name is not null").distinct()


def _name_pairs(spark, sf_dir):
    names = _names(spark, sf_dir)
    return names.select(F.col("p_name").alias("a")).join(names.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))


def _name_corpus(spark, sf_dir):
    """Distinct names numbered by their first part."""
    return _t(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("idx"))


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def _vectors(spark, sf_dir):
    return cosine.normalised(cosine.tfidf(_docs(spark, sf_dir), "doc_id", cosine.short_names(_lines())))


def ro_ratio_part_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.ratio("a", "b").alias("r"))


def ro_ratio_reversed(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.ratio("b", "a").alias("r"))


def ro_ratio_nation_region(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("a")), _t(spark, sf_dir, "region").select(F.col("r_name").alias("b"))
    return n.join(r, F.lit(True)).select("a", "b", columns.ratio("a", "b").alias("r"))


def ro_topk_part_names(spark, sf_dir):
    return ro_ratio_part_names(spark, sf_dir).orderBy(F.desc("r"), "a", "b").limit(25)


def ratio_many_part_names(spark, sf_dir):
    return Rationer(threads=8).ratio_many(_name_pairs(spark, sf_dir)).select("a", "b", F.col("ratio").alias("r"))


def ratio_capped_part_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.ratio_capped("a", "b", 0.5).alias("r"))


def qualifies_part_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.qualifies("a", "b", 0.6).alias("q"), columns.edge("a", "b", 0.6).alias("r"))


def ratio_many_idx_nation(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("text"))
    p = n.select(F.col("idx").alias("i")).join(n.select(F.col("idx").alias("j")), F.col("i") != F.col("j"))
    return Rationer().prepare(n).ratio_many_idx(p).select("i", "j", F.col("ratio").alias("r"))


def real_quick_ratio_docs(spark, sf_dir):
    """Every document against the longest text of its source."""
    d = _docs(spark, sf_dir)
    longest = d.groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("other"))
    other = d.select(F.col("doc_id").alias("other"), F.col("text").alias("b"))
    return d.join(longest, "source").join(other, "other").select("doc_id", "other", columns.real_quick_ratio("text", "b").alias("q"))


def quick_ratio_part(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.quick_ratio("a", "b").alias("q"), columns.real_quick_ratio("a", "b").alias("rq"))


def char_counts_docs(spark, sf_dir):
    """Characters of all whole texts, counted by document."""
    chars = _docs(spark, sf_dir).where("text <> ''").select("doc_id", F.explode(F.split("text", "")).alias("c"))
    return chars.groupBy("doc_id", "c").agg(F.count("*").alias("n"))


def char_counts_part(spark, sf_dir):
    return _names(spark, sf_dir).select("p_name", F.explode(columns.char_counts("p_name")).alias("x")).select("p_name", "x.c", F.col("x.n").cast("long").alias("n"))


def ascii_profile_nation(spark, sf_dir):
    prof = _t(spark, sf_dir, "nation").select("n_name", F.posexplode(columns.ascii_profile("n_name")).alias("code", "n"))
    return prof.where("n > 0").select("n_name", F.col("code").cast("long").alias("code"), F.col("n").cast("long").alias("n"))


def length_blocked_pairs(spark, sf_dir):
    """How many pairs of documents the length bound leaves, for several thresholds."""
    sizes = _docs(spark, sf_dir).where("text is not null").groupBy(F.length("text").alias("n")).agg(F.count("*").alias("c"))
    a, b = sizes, sizes.select(F.col("n").alias("m"), F.col("c").alias("d"))
    out = None
    for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95):
        ok = F.when(F.col("m") == 0, True).otherwise(2.0 * F.col("n") / F.nullif(F.col("n") + F.col("m"), F.lit(0)) >= t)
        met = a.join(b, (F.col("n") <= F.col("m")) & ok)
        one = met.agg(F.sum(F.when(F.col("n") == F.col("m"), F.expr("c * (c - 1) div 2")).otherwise(F.col("c") * F.col("d"))).alias("n_pairs")).select(F.lit(t).alias("t"), "n_pairs")
        out = one if out is None else out.union(one)
    return out


def qualifying_pairs_parts(spark, sf_dir):
    return pairs.similarity_join(_name_corpus(spark, sf_dir), "idx", "p_name", 0.75).select("i", "j", F.col("ratio").alias("r"))


def join_counts_turns(spark, sf_dir):
    """All pairs of turns of conversations: how many reach 0.8, and how many pass the bounds by lengths and characters."""
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return pairs.join_counts(turns, "id", "text", 0.8)


def all_pairs_sum_parts(spark, sf_dir):
    return ro_ratio_part_names(spark, sf_dir).agg(F.round(F.sum("r"), 6).alias("total"), F.count("*").alias("n"))


def cluster_parts(spark, sf_dir):
    return cluster.cluster_canonicals(_name_corpus(spark, sf_dir), "idx", "p_name", 0.75)


def cluster_parts_multi(spark, sf_dir):
    grouped = _t(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("idx"))
    return cluster.cluster_canonicals_multi(grouped, "p_type", "idx", "p_name", 0.75)


def cluster_sizes_parts(spark, sf_dir):
    return cluster.cluster_sizes(cluster_parts(spark, sf_dir)).select(F.col("size").cast("long").alias("size"), F.col("count").alias("n"))


def cluster_docs_multi(spark, sf_dir):
    return cluster.cluster_canonicals_multi(_docs(spark, sf_dir), "source", "doc_id", "text", 0.85)


def cluster_docs_lsh(spark, sf_dir):
    return cluster.cluster_canonicals_lsh(_docs(spark, sf_dir), "doc_id", "text", 0.85)


def tfidf_weights_docs(spark, sf_dir):
    w = cosine.tfidf(_docs(spark, sf_dir), "doc_id", _lines())
    return w.select(F.col("id").alias("doc_id"), F.md5(F.col("dim").cast("binary")).alias("tok"), F.round("w", 6).alias("w"))


def doc_freq_docs(spark, sf_dir):
    df = cosine.document_frequency(cosine.exploded(_docs(spark, sf_dir), "doc_id", _lines()))
    return df.select(F.md5(F.col("tok").cast("binary")).alias("tok"), "df")


def idf_docs(spark, sf_dir):
    d = _docs(spark, sf_dir)
    n = d.count()
    df = cosine.document_frequency(cosine.exploded(d, "doc_id", _lines()))
    return df.select(F.md5(F.col("tok").cast("binary")).alias("tok"), F.round(F.log(F.lit(float(n)) / F.col("df")), 6).alias("idf"))


def _rounded(df):
    return df.select("j", "i", F.round("cos", 6).alias("cos"))


def cosine_join_docs_t08(spark, sf_dir):
    return _rounded(cosine.cosine_join(_vectors(spark, sf_dir), 0.8))


def cosine_join_docs_t05(spark, sf_dir):
    return _rounded(cosine.cosine_join(_vectors(spark, sf_dir), 0.5))


def cosine_join_bruteforce_docs(spark, sf_dir):
    return _rounded(cosine.cosine_join_bruteforce(_vectors(spark, sf_dir), 0.8))


def cosine_join_sweep(spark, sf_dir):
    """Pairs at several thresholds from vectors that are prepared once."""
    joiner = CosineJoiner.from_token_docs(_docs(spark, sf_dir), "doc_id", _lines())
    out = None
    for t in (0.6, 0.7, 0.9):
        one = joiner.join(t).agg(F.count("*").alias("n_pairs")).select(F.lit(t).alias("t"), "n_pairs")
        out = one if out is None else out.union(one)
    return out


def cosine_from_rows_lineitem(spark, sf_dir):
    """Orders as sparse rows of parts by quantity."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dim"), F.col("l_quantity").alias("w"))
    return _rounded(CosineJoiner.from_rows(rows).join(0.7))


def cosine_join_counts_docs(spark, sf_dir):
    return cosine.cosine_join_counts(_vectors(spark, sf_dir), 0.8)


def dim_rank_maxw(spark, sf_dir):
    """Parts ranked by their greatest weight in an order."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dim"), F.col("l_quantity").alias("w"))
    summed = rows.groupBy("id", "dim").agg(F.sum("w").alias("w"))
    return cosine.dim_ranks(summed).select("dim", "maxw", F.col("rank").cast("long").alias("rank"))


def delta_chain_cap(spark, sf_dir):
    deltas = spark.createDataFrame([(d,) for d in (-1.0, 0.0, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)], "delta double")
    return deltas.select("delta", columns.delta_to_chain_cap("delta").alias("cap"))


def shingle_hashes_bench(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(lsh.shingle_hashes("text")).alias("h"))


def minhash_signatures_bench(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(lsh.minhash("text", 16)).alias("k", "m")).select("id", F.col("k").cast("long").alias("k"), "m")


def lsh_candidates_docs(spark, sf_dir):
    return lsh.candidates(_docs(spark, sf_dir), "doc_id", "text", 128, 4)


def lsh_candidates_turns(spark, sf_dir):
    """Turns of conversations that share one of sixteen hashes."""
    turns = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return lsh.candidates(turns, "id", "text", 16, 1)


LIST = ["tide", "diet", "", "tide", "žluť"]


def list_source(spark, sf_dir):
    return corpora.from_list(spark, LIST)


def _nul_file(spark, sf_dir):
    path = fresh_path(spark, "nul")
    corpora.write_nul_separated(_t(spark, sf_dir, "benchmark"), path)
    return path


def nul_source_benchmark(spark, sf_dir):
    """All texts of ``benchmark``, written and read as NUL-separated entries."""
    return corpora.read_nul_separated(spark, _nul_file(spark, sf_dir))


def nul_sample_benchmark(spark, sf_dir):
    """The reader's seeded sample of ten entries."""
    return corpora.read_nul_separated(spark, _nul_file(spark, sf_dir), sample=10, errors="surrogatepass")


def sparse_file_nation(spark, sf_dir):
    """Nations as a binary sparse-row file: row ``k`` has the dimensions region and 100 + nation."""
    rows = [[(r.n_regionkey, 0.5), (100 + r.n_nationkey, float(r.n_nationkey))] for r in _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    path = fresh_path(spark, "sparse")
    corpora.write_sparse_file(spark, rows, path)
    return corpora.read_sparse_rows(spark, path).select("id", "dim", "w")


def zipf_rows(spark, sf_dir):
    return corpora.zipf_rows(spark, 2000).select("id", "dim", F.round("w", 9).alias("w"))


def matching_stats_nation(spark, sf_dir):
    """Every nation against every region: the longest match that ends at each place, and the sum of all."""
    n, r = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("a")), _t(spark, sf_dir, "region").select(F.col("r_name").alias("b"))
    pairs_ = n.join(r, F.lit(True))
    stats = pairs_.select("a", "b", F.posexplode(columns.matching_stats("a", "b")).alias("k", "m"))
    return stats.select("a", "b", F.col("k").cast("long").alias("k"), F.col("m").cast("long").alias("m"))


def matching_stats_cost_parts(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.matching_stats_cost("a", "b").alias("cost"))


def b2j_ratio_part_names(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.b2j_ratio("a", "b").alias("r"))


def work_estimate_parts(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", columns.work_estimate("a", "b").alias("work"))


def rationer_edge_nation_region(spark, sf_dir):
    """A handle's ratio and edge, with an approximation allowed that changes nothing."""
    n, r = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("a")), _t(spark, sf_dir, "region").select(F.col("r_name").alias("b"))
    held = Rationer("CPU", delta=0.2)
    return n.join(r, F.lit(True)).select("a", "b", held.ratio("a", "b").alias("r"), held.edge("a", "b", 0.5).alias("e"))


def prepared_sizes(spark, sf_dir):
    """How many texts prepared corpora hold."""
    whole = Rationer().prepare(_t(spark, sf_dir, "nation"), "n_nationkey", "n_name")
    none = Rationer().prepare(_t(spark, sf_dir, "nation").where("false"), "n_nationkey", "n_name")
    return spark.createDataFrame([("all", len(whole), whole.is_empty()), ("none", len(none), none.is_empty())], "corpus string, n long, is_empty boolean")


def backend_names(spark, sf_dir):
    """The accepted names and the backend that does the work; another name raises ValueError."""

    def of(name):
        try:
            return backend(name)
        except ValueError:
            return "ValueError"

    names = [*BACKENDS, *[x.upper() for x in BACKENDS], "tpu", ""]
    return spark.createDataFrame([(x, of(x)) for x in names], "name string, backend string")


def join_counts_parts(spark, sf_dir):
    return pairs.join_counts(_name_corpus(spark, sf_dir), "idx", "p_name", 0.75)


def all_pairs_nation(spark, sf_dir):
    """A threshold of 0 lets all pairs through."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.col("n_name").alias("text"))
    return pairs.similarity_join(n, t=0.0).select("i", "j", F.col("ratio").alias("r"))


def symmetric_difference_parts(spark, sf_dir):
    """What the joins at two thresholds have apart."""
    corpus = _name_corpus(spark, sf_dir)
    wide, narrow = (pairs.similarity_join(corpus, "idx", "p_name", t).select("i", "j", F.col("ratio").alias("r")) for t in (0.75, 0.8))
    return pairs.symmetric_difference(narrow.where("i % 3 <> 0"), wide.where("i % 3 <> 1")).select("i", "j", "r", "side")


def cosine_pairs_docs(spark, sf_dir):
    """Each document against the next: given pairs, whether or not they share a line."""
    v = _vectors(spark, sf_dir)
    asked = _docs(spark, sf_dir).select(F.col("doc_id").alias("j"), (F.col("doc_id") + 1).alias("i"))
    return _rounded(cosine.cosine_pairs(v, asked))


def cosine_all_pairs_nation(spark, sf_dir):
    """Nations as vectors of their regions and keys; a threshold of 0 gives all pairs."""
    n = _t(spark, sf_dir, "nation")
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("dim"), F.lit(2.0).alias("w")).union(
        n.select(F.col("n_nationkey").cast("long"), F.col("n_nationkey").cast("long") + 100, F.lit(1.0))
    )
    return _rounded(cosine.cosine_join_bruteforce(cosine.normalised(rows), 0.0))


QUERIES = {f.__name__: f for f in (
    ro_ratio_part_names, ro_ratio_reversed, ro_ratio_nation_region, ro_topk_part_names, ratio_many_part_names, ratio_capped_part_names,
    qualifies_part_names, ratio_many_idx_nation, real_quick_ratio_docs, quick_ratio_part, char_counts_docs, char_counts_part, ascii_profile_nation,
    length_blocked_pairs, qualifying_pairs_parts, join_counts_turns, all_pairs_sum_parts, cluster_parts, cluster_parts_multi, cluster_sizes_parts, cluster_docs_multi,
    cluster_docs_lsh, tfidf_weights_docs, doc_freq_docs, idf_docs, cosine_join_docs_t08, cosine_join_docs_t05, cosine_join_bruteforce_docs,
    cosine_join_sweep, cosine_from_rows_lineitem, cosine_join_counts_docs, dim_rank_maxw, delta_chain_cap, shingle_hashes_bench,
    minhash_signatures_bench, lsh_candidates_docs, lsh_candidates_turns, list_source, nul_source_benchmark,
    nul_sample_benchmark, sparse_file_nation, zipf_rows, matching_stats_nation, matching_stats_cost_parts, b2j_ratio_part_names,
    work_estimate_parts, rationer_edge_nation_region, prepared_sizes, backend_names, join_counts_parts, all_pairs_nation,
    symmetric_difference_parts, cosine_pairs_docs, cosine_all_pairs_nation,
)}


def _ro(pairs_sql: str, name: str = "ro") -> str:
    """CTEs that end in ``name(a, b, r)``: windows are carried by recursion, the best match is longest, then earliest."""
    return f"""p0 AS ({pairs_sql}), p AS (SELECT DISTINCT a, b FROM p0),
 win(a, b, al, ar, bl, br, m) AS (
  SELECT a, b, 0, length(a), 0, length(b), 0 FROM p
  UNION ALL
  SELECT a, b, CASE side WHEN 0 THEN al ELSE bi + bk END, CASE side WHEN 0 THEN bi ELSE ar END,
    CASE side WHEN 0 THEN bl ELSE bj + bk END, CASE side WHEN 0 THEN bj ELSE br END, CASE side WHEN 0 THEN bk ELSE 0 END
  FROM (SELECT a, b, al, ar, bl, br, best.i::BIGINT bi, best.j::BIGINT bj, -best.nk::BIGINT bk FROM (
      SELECT a, b, al, ar, bl, br, list_min(flatten(list_transform(range(al, ar), lambda i: list_transform(range(bl, br), lambda j:
        struct_pack(nk := -coalesce(len(list_filter(range(1, least(ar - i, br - j) + 1), lambda k: substr(a, (i + 1)::INT, k::INT) = substr(b, (j + 1)::INT, k::INT))), 0), i := i, j := j))))) best
      FROM win WHERE ar > al AND br > bl) WHERE best.nk < 0), (VALUES (0), (1)) s(side)),
 {name} AS MATERIALIZED (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(m) / (length(a) + length(b)) END::DOUBLE r FROM win GROUP BY a, b)"""


_PARTS = "SELECT a.t a, b.t b FROM (SELECT DISTINCT p_name t FROM part) a, (SELECT DISTINCT p_name t FROM part) b WHERE a.t < b.t"
_BOTH = "SELECT a.t a, b.t b FROM (SELECT DISTINCT p_name t FROM part) a, (SELECT DISTINCT p_name t FROM part) b WHERE a.t <> b.t"


def _cluster_sql(corpus: str) -> str:
    """Clusters of ``corpus(grp, idx, t)`` at 0.75; the row with the lower id comes first in a ratio."""
    return f"""WITH RECURSIVE {_ro(_BOTH)}, c AS MATERIALIZED ({corpus}),
 q AS MATERIALIZED (SELECT x.grp, x.idx i, y.idx j, ro.r FROM c x JOIN c y ON x.grp = y.grp AND x.idx < y.idx JOIN ro ON ro.a = x.t AND ro.b = y.t),
 e AS (SELECT grp, i, j FROM q WHERE r >= 0.75), u AS MATERIALIZED (SELECT grp, i, j FROM e UNION ALL SELECT grp, j, i FROM e),
 reach(grp, i, j) AS (SELECT DISTINCT grp, i, i FROM u UNION SELECT reach.grp, reach.i, u.j FROM reach JOIN u ON u.grp = reach.grp AND u.i = reach.j),
 lab AS (SELECT grp, i, min(j) cluster_id FROM reach GROUP BY grp, i),
 ms AS (SELECT a.grp, a.cluster_id, min(q.r) min_sim FROM lab a JOIN lab b ON a.grp = b.grp AND a.cluster_id = b.cluster_id AND a.i < b.i JOIN q ON q.grp = a.grp AND q.i = a.i AND q.j = b.i GROUP BY ALL),
 clusters AS (SELECT grp, cluster_id, list(i ORDER BY i) members, any_value(min_sim) min_sim FROM lab JOIN ms USING (grp, cluster_id) GROUP BY grp, cluster_id)"""


_ALL_PARTS = "SELECT '' grp, min(p_partkey) idx, p_name t FROM part GROUP BY p_name"
_TF = """tf AS (SELECT doc_id, tok, count(*) tf FROM (SELECT doc_id, unnest(string_split(text, chr(10))) tok FROM documents) GROUP BY ALL),
 n AS (SELECT count(*)::DOUBLE n FROM documents), df AS (SELECT tok, count(*) df FROM tf GROUP BY tok),
 w AS (SELECT doc_id id, tok dim, tf * ln(n / df) w FROM tf JOIN df USING (tok), n)"""


def _cos_sql(weights: str, t: float) -> str:
    return f"""WITH {weights}, nm AS (SELECT id, sqrt(sum(w * w)) nrm FROM w GROUP BY id HAVING sqrt(sum(w * w)) > 0),
 v AS MATERIALIZED (SELECT id, dim, w / nrm w FROM w JOIN nm USING (id) WHERE w <> 0)
 SELECT a.id j, b.id i, round(sum(a.w * b.w), 6) cos FROM v a JOIN v b ON a.dim = b.dim AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= {t} - 1e-9"""


_ROWS = "w AS (SELECT l_orderkey id, l_partkey dim, sum(l_quantity) w FROM lineitem GROUP BY ALL)"
_FNV = """x AS (SELECT {id} id, hex(encode(text)) h, octet_length(encode(text)) n FROM {table}),
 g AS (SELECT id, unnest(CASE WHEN n <= 9 THEN [h] ELSE list_transform(range(0, n - 8), lambda i: substr(h, (2 * i + 1)::INT, 18)) END) g FROM x),
 f AS MATERIALIZED (SELECT DISTINCT id, list_reduce(list_transform(range(0, length(g) // 2), lambda k: ('0x' || substr(g, (2 * k + 1)::INT, 2))::UTINYINT::UBIGINT),
  lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, 14695981039346656037::UBIGINT) h FROM g)"""


def _minhash_sql(n: int, id_: str = "item_id", table: str = "benchmark") -> str:
    a, b = lsh.permutations(n)
    values = ", ".join(f"({k}, {int(x)}::UBIGINT, {int(y)}::UBIGINT)" for k, (x, y) in enumerate(zip(a, b)))
    return f"""{_FNV.format(id=id_, table=table)},
 sig AS MATERIALIZED (SELECT id, k::BIGINT k, min(((a::UHUGEINT * h::UHUGEINT + b::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) m FROM f, (VALUES {values}) p(k, a, b) GROUP BY id, k)"""


def _zipf_sql(n: int) -> str:
    def draw(a: str, b: str) -> str:
        x = f"(({a} * 1000003 + {b} * 7919 + 117074) % 2147483647)"
        for root in (48271, 16807, 48271, 16807):
            x = f"(({x} * {root} + {a} + {b}) % 2147483647)"
        return f"(({x} + 0.5::DOUBLE) / 2147483647)"

    return f"""SELECT id, floor(u * u * u * 20000)::BIGINT dim, round(ln(2.0 + floor(u * u * u * 20000) / 50), 9) w FROM (SELECT id, {draw("l", "k")} u FROM (
 SELECT id, k, CASE WHEN {draw("id", "14::BIGINT")} < 0.05 AND k > 0 THEN id - 1 ELSE id END l FROM (SELECT unnest(range(0, {n})) id), (SELECT unnest(range(0, 14)) k)))"""


def _cosine_counts_sql(t: float) -> str:
    return f"""WITH {_TF}, nm AS (SELECT id, sqrt(sum(w * w)) nrm FROM w GROUP BY id HAVING sqrt(sum(w * w)) > 0),
 v AS MATERIALIZED (SELECT id, md5(dim) dim, w / nrm w FROM w JOIN nm USING (id) WHERE w <> 0),
 r AS (SELECT v.*, sum(w * maxw) OVER o >= {t} - 1e-9 held, sqrt(coalesce(sum(w * w) OVER (PARTITION BY id ORDER BY maxw, dim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) below
   FROM v JOIN (SELECT dim, max(w) maxw FROM v GROUP BY dim) USING (dim) WINDOW o AS (PARTITION BY id ORDER BY maxw, dim ROWS UNBOUNDED PRECEDING)),
 x AS MATERIALIZED (SELECT *, sqrt(sum(CASE WHEN held THEN 0 ELSE w * w END) OVER (PARTITION BY id)) rest FROM r),
 c AS MATERIALIZED (SELECT a.id j, b.id i, sum(a.w * b.w) part, max(a.rest) * min(b.below) more FROM x a JOIN x b ON a.dim = b.dim AND a.id < b.id WHERE a.held GROUP BY ALL)
 SELECT (SELECT count(*) FROM c) candidates, (SELECT count(*) FROM c WHERE part + more >= {t} - 1e-9) survivors, (SELECT count(*) FROM ({_cos_sql(_TF, t)})) pairs"""


def oracle() -> dict[str, str]:
    """DuckDB SQL by query; the clusterings of long texts have none and are tested against the standard library's matcher."""
    bands = ", b AS (SELECT id, k band, list(m ORDER BY k) v FROM sig GROUP BY ALL) SELECT DISTINCT x.id i, y.id j FROM b x JOIN b y ON x.band = y.band AND x.v = y.v AND x.id < y.id"
    hexed = "lpad(lower(to_hex({})), 16, '0')"
    parts = "WITH RECURSIVE " + _ro(_PARTS)
    length_pairs = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE t, sum(CASE WHEN n = m THEN c * (c - 1) // 2 ELSE c * d END)::BIGINT n_pairs FROM s, (SELECT n m, c d FROM s) WHERE n <= m AND (m = 0 OR 2.0::DOUBLE * n / (n + m) >= {t}::DOUBLE)"
        for t in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
    )
    sweep = " UNION ALL ".join(f"SELECT {t}::DOUBLE t, count(*) n_pairs FROM c WHERE cos >= {t} - 1e-9" for t in (0.6, 0.7, 0.9))
    chars = "(SELECT p_name, unnest(string_split(p_name, '')) c FROM (SELECT DISTINCT p_name FROM part))"
    return {
        "ro_ratio_part_names": f"{parts} SELECT a, b, r FROM ro",
        "ratio_many_part_names": f"{parts} SELECT a, b, r FROM ro",
        "ro_ratio_reversed": "WITH RECURSIVE " + _ro(_BOTH) + " SELECT b a, a b, r FROM ro WHERE b < a",
        "ro_ratio_nation_region": "WITH RECURSIVE " + _ro("SELECT n_name a, r_name b FROM nation, region") + " SELECT a, b, r FROM ro",
        "ro_topk_part_names": f"{parts} SELECT a, b, r FROM ro ORDER BY r DESC, a, b LIMIT 25",
        "ratio_capped_part_names": f"{parts} SELECT a, b, CASE WHEN r <= 0.5 THEN r ELSE 2.0 END::DOUBLE r FROM ro",
        "qualifies_part_names": f"{parts} SELECT a, b, r >= 0.6 q, CASE WHEN r >= 0.6 THEN r END r FROM ro",
        "ratio_many_idx_nation": "WITH RECURSIVE " + _ro("SELECT x.n_name a, y.n_name b FROM nation x, nation y WHERE x.n_nationkey <> y.n_nationkey")
        + " SELECT x.n_nationkey::BIGINT i, y.n_nationkey::BIGINT j, ro.r FROM nation x JOIN ro ON ro.a = x.n_name JOIN nation y ON y.n_name = ro.b WHERE x.n_nationkey <> y.n_nationkey",
        "real_quick_ratio_docs": """WITH l AS (SELECT source, doc_id other, text b FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id DESC) = 1)
 SELECT doc_id, other, CASE WHEN length(text) + length(b) = 0 THEN 1.0 ELSE 2.0 * least(length(text), length(b)) / (length(text) + length(b)) END::DOUBLE q FROM documents JOIN l USING (source)""",
        "quick_ratio_part": f"""WITH p AS ({_PARTS}), c AS (SELECT p_name, c, count(*) n FROM {chars} GROUP BY ALL),
 m AS (SELECT p.a, p.b, sum(least(x.n, y.n)) m FROM p JOIN c x ON x.p_name = p.a JOIN c y ON y.p_name = p.b AND x.c = y.c GROUP BY ALL)
 SELECT a, b, (2.0 * coalesce(m, 0) / (length(a) + length(b)))::DOUBLE q, (2.0 * least(length(a), length(b)) / (length(a) + length(b)))::DOUBLE rq FROM p LEFT JOIN m USING (a, b)""",
        "char_counts_docs": "SELECT doc_id, c, count(*) n FROM (SELECT doc_id, unnest(string_split(text, '')) c FROM documents WHERE text <> '') GROUP BY ALL",
        "char_counts_part": f"SELECT p_name, c, count(*) n FROM {chars} GROUP BY ALL",
        "ascii_profile_nation": "SELECT n_name, least(128, unicode(c))::BIGINT code, count(*) n FROM (SELECT n_name, unnest(string_split(n_name, '')) c FROM nation) GROUP BY ALL",
        "length_blocked_pairs": f"WITH s AS (SELECT length(text) n, count(*) c FROM documents WHERE text IS NOT NULL GROUP BY 1) {length_pairs}",
        "qualifying_pairs_parts": "WITH RECURSIVE " + _ro(_BOTH) + f", c AS ({_ALL_PARTS}) SELECT x.idx i, y.idx j, ro.r FROM c x JOIN c y ON x.idx < y.idx JOIN ro ON ro.a = x.t AND ro.b = y.t WHERE ro.r >= 0.75",
        "all_pairs_sum_parts": f"{parts} SELECT round(sum(r), 6) total, count(*) n FROM ro",
        "cluster_parts": _cluster_sql(_ALL_PARTS) + " SELECT cluster_id, members, min_sim FROM clusters",
        "cluster_parts_multi": _cluster_sql("SELECT p_type grp, min(p_partkey) idx, p_name t FROM part GROUP BY p_type, p_name") + " SELECT grp, cluster_id, members, min_sim FROM clusters",
        "cluster_sizes_parts": _cluster_sql(_ALL_PARTS) + " SELECT len(members)::BIGINT size, count(*) n FROM clusters GROUP BY 1 ORDER BY 1 DESC LIMIT 6",
        "tfidf_weights_docs": f"WITH {_TF} SELECT id doc_id, md5(dim) tok, round(w, 6) w FROM w WHERE w > 0",
        "doc_freq_docs": f"WITH {_TF} SELECT md5(tok) tok, df FROM df",
        "idf_docs": f"WITH {_TF} SELECT md5(tok) tok, round(ln(n / df), 6) idf FROM df, n",
        "cosine_join_docs_t08": _cos_sql(_TF, 0.8),
        "cosine_join_docs_t05": _cos_sql(_TF, 0.5),
        "cosine_join_bruteforce_docs": _cos_sql(_TF, 0.8),
        "cosine_join_sweep": f"WITH c AS ({_cos_sql(_TF, 0.55)}) {sweep}",
        "cosine_from_rows_lineitem": _cos_sql(_ROWS, 0.7),
        "dim_rank_maxw": f"WITH {_ROWS} SELECT dim, max(w) maxw, row_number() OVER (ORDER BY max(w), dim) rank FROM w GROUP BY dim",
        "delta_chain_cap": "SELECT d delta, c::BIGINT cap FROM (VALUES (-1.0::DOUBLE, 4294967295), (0.0, 4294967295), (1.0, 1), (2.0, 1)) v(d, c) UNION ALL"
        + " SELECT d, greatest(1, ceil(1 / sqrt(d)))::BIGINT FROM (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2), (0.5)) v(d)",
        "shingle_hashes_bench": f"WITH {_FNV.format(id='item_id', table='benchmark')} SELECT id, {hexed.format('h')} h FROM f",
        "minhash_signatures_bench": f"WITH {_minhash_sql(16)} SELECT id, k, {hexed.format('m')} m FROM sig",
        "lsh_candidates_turns": f"WITH {_minhash_sql(16, 'conv_id * 1000 + turn', 'conversations')} {bands}",
        "list_source": "SELECT i::BIGINT idx, t AS text FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(LIST)) + ") v(i, t)",
        "nul_source_benchmark": "SELECT text FROM benchmark WHERE text <> ''",
        "nul_sample_benchmark": "SELECT text FROM benchmark WHERE text <> '' ORDER BY md5('13:' || text), text LIMIT 10",
        "sparse_file_nation": "SELECT n_nationkey::BIGINT id, n_regionkey::BIGINT dim, 0.5::DOUBLE w FROM nation UNION ALL SELECT n_nationkey, 100 + n_nationkey, n_nationkey FROM nation",
        "zipf_rows": _zipf_sql(2000),
        "matching_stats_nation": """SELECT n_name a, r_name b, k, list_max(list_filter(range(0, k + 2), lambda m: m = 0 OR contains(r_name, substr(n_name, (k + 2 - m)::INT, m::INT)))) m
 FROM (SELECT n_name, r_name, unnest(range(0, length(n_name))) k FROM nation, region)""",
        "matching_stats_cost_parts": f"""SELECT a, b, sum(list_max(list_filter(range(0, k + 2), lambda m: m = 0 OR contains(b, substr(a, (k + 2 - m)::INT, m::INT)))))::BIGINT AS cost
 FROM (SELECT a, b, unnest(range(0, length(a))) k FROM ({_PARTS})) GROUP BY a, b""",
        "b2j_ratio_part_names": f"{parts} SELECT a, b, r FROM ro",
        "work_estimate_parts": f"""WITH p AS ({_PARTS}), c AS (SELECT p_name, c, count(*) n FROM {chars} GROUP BY ALL)
 SELECT p.a, p.b, coalesce(sum(x.n * y.n), 0)::BIGINT AS work FROM p LEFT JOIN c x ON x.p_name = p.a LEFT JOIN c y ON y.p_name = p.b AND x.c = y.c GROUP BY ALL""",
        "rationer_edge_nation_region": "WITH RECURSIVE " + _ro("SELECT n_name a, r_name b FROM nation, region") + " SELECT a, b, r, CASE WHEN r >= 0.5 THEN r END e FROM ro",
        "prepared_sizes": "SELECT 'all' corpus, count(*) n, count(*) = 0 is_empty FROM nation UNION ALL SELECT 'none', 0, true",
        "backend_names": "SELECT n AS name, CASE WHEN lower(n) IN ('cpu', 'gpu', 'gpu+cpu', 'gpucpu', 'gpu_cpu') THEN 'cpu' ELSE 'ValueError' END backend FROM (VALUES "
        + "('cpu'), ('gpu'), ('gpu+cpu'), ('gpucpu'), ('gpu_cpu'), ('CPU'), ('GPU'), ('GPU+CPU'), ('GPUCPU'), ('GPU_CPU'), ('tpu'), ('')) v(n)",
        "join_counts_parts": "WITH RECURSIVE " + _ro(_BOTH) + f""", c AS ({_ALL_PARTS}), k AS (SELECT p_name, c, count(*) n FROM {chars} GROUP BY ALL),
 q AS (SELECT x.idx i, y.idx j, x.t a, y.t b FROM c x JOIN c y ON x.idx < y.idx),
 m AS (SELECT q.i, q.j, sum(least(x.n, y.n)) m FROM q JOIN k x ON x.p_name = q.a JOIN k y ON y.p_name = q.b AND x.c = y.c GROUP BY ALL)
 SELECT count(*) FILTER (r >= 0.75) qualifying, count(*) FILTER (2.0::DOUBLE * coalesce(m, 0) >= 0.75::DOUBLE * (length(q.a) + length(q.b))) verified
 FROM q JOIN ro ON ro.a = q.a AND ro.b = q.b LEFT JOIN m USING (i, j)""",
        "all_pairs_nation": "WITH RECURSIVE " + _ro("SELECT x.n_name a, y.n_name b FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey")
        + " SELECT x.n_nationkey::BIGINT i, y.n_nationkey::BIGINT j, ro.r FROM nation x JOIN ro ON ro.a = x.n_name JOIN nation y ON y.n_name = ro.b WHERE x.n_nationkey < y.n_nationkey",
        "symmetric_difference_parts": "WITH RECURSIVE " + _ro(_BOTH) + f""", c AS ({_ALL_PARTS}), q AS (SELECT x.idx i, y.idx j, ro.r FROM c x JOIN c y ON x.idx < y.idx JOIN ro ON ro.a = x.t AND ro.b = y.t),
 l AS (SELECT * FROM q WHERE r >= 0.8 AND i % 3 <> 0), w AS (SELECT * FROM q WHERE r >= 0.75 AND i % 3 <> 1)
 SELECT *, 'left' side FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM w) UNION ALL SELECT *, 'right' FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM l)""",
        "cosine_pairs_docs": f"""WITH {_TF}, nm AS (SELECT id, sqrt(sum(w * w)) nrm FROM w GROUP BY id HAVING sqrt(sum(w * w)) > 0), v AS (SELECT id, dim, w / nrm w FROM w JOIN nm USING (id) WHERE w <> 0)
 SELECT d.doc_id j, d.doc_id + 1 i, round(coalesce(sum(a.w * b.w), 0.0), 6) cos FROM documents d LEFT JOIN v a ON a.id = d.doc_id LEFT JOIN v b ON b.id = d.doc_id + 1 AND b.dim = a.dim GROUP BY ALL""",
        "cosine_all_pairs_nation": """SELECT a.n_nationkey::BIGINT j, b.n_nationkey::BIGINT i, CASE WHEN a.n_regionkey = b.n_regionkey THEN 0.8 ELSE 0.0 END::DOUBLE cos
 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""",
        "cosine_join_counts_docs": _cosine_counts_sql(0.8),
    }
