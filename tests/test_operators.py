"""Spark operators against plain Python over small tables."""

import math
import random
import struct
from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import quillmatch
from quillmatch.functions import columns
from quillmatch.operators import cluster, cosine, lsh, pairs
from quillmatch.operators.handles import BACKENDS, CosineJoiner, Rationer
from quillmatch.plans.components import connected_components
from quillmatch.sources import corpora


def standard(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def corpus(seed, n=40, alphabet="abc ", most=24):
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and draw.random() < 0.6:
            t = list(draw.choice(texts))
            for _ in range(draw.randint(0, 2)):
                t.insert(draw.randint(0, len(t)), draw.choice(alphabet))
            texts.append("".join(t))
        else:
            texts.append("".join(draw.choice(alphabet) for _ in range(draw.randint(0, most))))
    return texts


def brute_clusters(texts, t):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    r = {(i, j): standard(texts[i], texts[j]) for i, j in combinations(range(len(texts)), 2)}
    for (i, j), v in r.items():
        if v >= t:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return sorted((m, min(r[p] for p in combinations(m, 2))) for m in groups.values() if len(m) > 1)


@pytest.mark.parametrize("t", [0.5, 0.75, 1.0])
def test_join_and_clusters(spark, t):
    texts = corpus(int(t * 100))
    df = spark.createDataFrame([*enumerate(texts), (None, "abc"), (99, None)], "idx long, text string")
    want = sorted((i, j, standard(texts[i], texts[j])) for i, j in combinations(range(len(texts)), 2) if standard(texts[i], texts[j]) >= t)
    assert sorted((r.i, r.j, r.ratio) for r in pairs.similarity_join(df, t=t).collect()) == want
    assert sorted((r.members, r.min_sim) for r in cluster.cluster_canonicals(df, t=t).collect()) == brute_clusters(texts, t)


def test_clusters_by_group(spark):
    one, two = corpus(1, 15), corpus(2, 15)
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate(one)] + [("y", i, s) for i, s in enumerate(two)], "g string, idx long, text string")
    got = cluster.cluster_canonicals_multi(df, "g", t=0.75).collect()
    for name, texts in (("x", one), ("y", two)):
        assert sorted((r.members, r.min_sim) for r in got if r.grp == name) == brute_clusters(texts, 0.75)


def test_lsh_clusters_are_within_the_exact_ones(spark):
    texts = [s * 4 for s in corpus(7, 30, "abcdefgh ", 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    exact = brute_clusters(texts, 0.8)
    for r in cluster.cluster_canonicals_lsh(df, t=0.8, num_perm=64, band_rows=2).collect():
        assert any(set(r.members) <= set(m) for m, _ in exact)
        assert r.min_sim == min(standard(texts[i], texts[j]) for i, j in combinations(r.members, 2))
    assert lsh.candidates(df, band_rows=0).count() == 0


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "idx long, text string")
    assert pairs.similarity_join(empty).count() == 0 and cluster.cluster_canonicals(empty).count() == 0
    same = spark.createDataFrame([(i, "same") for i in range(5)], "idx long, text string")
    assert [(r.members, r.min_sim) for r in cluster.cluster_canonicals(same).collect()] == [([0, 1, 2, 3, 4], 1.0)]
    assert pairs.similarity_join(same, t=1.5).count() == 0
    few = spark.createDataFrame([(0, ""), (1, "ab"), (2, "ab"), (3, "zz")], "idx long, text string")
    want = sorted((i, j, standard(a, b)) for (i, a), (j, b) in combinations([(0, ""), (1, "ab"), (2, "ab"), (3, "zz")], 2))
    for t in (0.0, -1.0):
        assert sorted((r.i, r.j, r.ratio) for r in pairs.similarity_join(few, t=t).collect()) == want


def test_blocks_and_counts(spark, monkeypatch):
    """Many blocks give what one gives; counts are those of the funnel; clusters come by their first member."""
    texts = corpus(21, 60, "abcd ", 30)
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    monkeypatch.setattr(pairs, "BLOCK", 5)
    whole = {p: standard(texts[p[0]], texts[p[1]]) for p in combinations(range(len(texts)), 2)}
    for t in (0.4, 0.75):
        assert {(r.i, r.j): r.ratio for r in pairs.similarity_join(df, t=t).collect()} == {p: r for p, r in whole.items() if r >= t}
        got = [(r.members, r.min_sim) for r in cluster.cluster_canonicals(df, t=t).collect()]
        assert got == brute_clusters(texts, t)
    quick = {p: SequenceMatcher(None, texts[p[0]], texts[p[1]], autojunk=False) for p in whole}
    passed = sum(m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 for m in quick.values())
    assert tuple(pairs.join_counts(df, t=0.75).first()) == (sum(r >= 0.75 for r in whole.values()), passed)


def test_texts_are_moved_a_bounded_number_of_times(spark, monkeypatch):
    """However many texts a band has, each goes to a constant number of meetings; parts and sides give what one block gives."""
    texts = corpus(22, 90, "abcd é", 30)
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    _, classes = pairs.text_classes(df, "idx", "text", None)
    monkeypatch.setattr(pairs, "BLOCK", 2)
    dealt, sides = pairs._blocks(classes, 0.75)
    assert dealt.join(sides, ["grp", "band", "block"]).groupBy("cls").count().agg({"count": "max"}).first()[0] <= 3 * pairs.BLOCKS
    table = classes.withColumn("side", (F.col("cls") % 2).cast("int")).toArrow()
    table = table.set_column(table.schema.get_field_index("side"), "side", table.column("side"))
    for two in (False, True):
        side = table.column("side").to_pylist()
        one = table if two else table.set_column(table.schema.get_field_index("side"), "side", [[0] * len(side)])
        met = []
        for part in pairs._parts(one):
            cls, s = part.column("cls").to_pylist(), part.column("side").to_pylist()
            met += [frozenset((cls[i], cls[j])) for i in range(len(cls)) for j in range(len(cls)) if (s[i] < s[j] if any(s) else i < j)]
        names = table.column("cls").to_pylist()
        want = {frozenset((x, y)) for x, y in combinations(names, 2) if not two or x % 2 != y % 2}
        assert len(met) == len(want) and set(met) == want


def test_symmetric_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([("x", 1), ("z", 3)], "v string, k long")
    assert sorted(tuple(r) for r in pairs.symmetric_difference(a, b).collect()) == [(1, "x", "left"), (2, "y", "left"), (3, "z", "right")]


def test_lsh_recall(spark):
    """Of the pairs that reach 0.85, bands find nine in ten at least."""
    draw, texts = random.Random(4), []
    for _ in range(60):
        base = [draw.choice("abcdefghijklmnop ") for _ in range(draw.randint(150, 400))]
        texts.append("".join(base))
        for _ in range(draw.randint(1, 3)):
            t = base[:]
            for _ in range(draw.randint(1, 4)):
                t[draw.randrange(len(t))] = draw.choice("xyz")
            texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    want = {(r.i, r.j) for r in pairs.similarity_join(df, t=0.85).collect()}
    found = {(r.i, r.j) for r in lsh.candidates(df).collect()}
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)


def test_meetings_are_dealt_to_all_tasks(spark):
    """Groups of few bytes and much work stay apart, as many tasks as the session names."""
    df = spark.createDataFrame([(k, "g", k, "abc" * 5 + str(k), k, k) for k in range(40)], "cls long, component string, idx long, text string, lo long, hi long")
    assert pairs.least_ratios(df.drop("idx")).count() == 1
    assert pairs._apart(df.withColumn("meeting", F.col("cls"))).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_candidates_are_not_moved(spark, monkeypatch):
    """Rows go to the bands they share, in blocks where many share one; pairs come out once, also where ids repeat."""
    draw = random.Random(8)
    texts = ["".join(draw.choice("ab") for _ in range(14)) for _ in range(60)] + ["the same text in many rows"] * 30
    ids = [*range(85), 3, 7, 84, 84, 84]
    a, b = lsh.permutations(8)
    signed = [lsh.signature(x, a, b).reshape(4, 2).tolist() for x in texts]
    want = {(ids[x], ids[y]) for x in range(90) for y in range(90) if ids[x] < ids[y] and any(p == q for p, q in zip(signed[x], signed[y]))}
    monkeypatch.setattr(lsh, "BLOCK", 4)
    for n in (85, 90):
        df = spark.createDataFrame(list(zip(ids, texts))[:n], "idx long, text string")
        found = lsh.candidates(df, num_perm=8, band_rows=2)
        got = [(r.i, r.j) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if n == 90 or any(p == (x, y) for x in range(85) for y in range(x + 1, 85) if any(u == v for u, v in zip(signed[x], signed[y])))}
        if n == 85:  # no aggregation of pairs behind the meetings
            plan = found._jdf.queryExecution().optimizedPlan().toString()
            assert "Aggregate" not in plan.split("FlatMapGroupsInArrow")[0]


def test_top_level(spark):
    assert quillmatch.ratio("tide", "diet") == 0.25
    df = spark.createDataFrame([("tide", "diet")], "a string, b string")
    assert quillmatch.ratio(df).first().ratio == 0.25 and df.select(quillmatch.ratio(F.col("a"), F.col("b"))).first()[0] == 0.25
    docs = spark.createDataFrame([(0, ["p", "q"]), (1, ["p", "q"]), (2, ["r"])], "id long, tokens array<string>")
    assert [(r.j, r.i, round(r.cos, 9)) for r in quillmatch.cosine_join(docs, 0.8).collect()] == [(0, 1, 1.0)]
    assert all(hasattr(quillmatch, name) for name in quillmatch.__all__)


def test_columns(spark):
    texts = ["", "a", "tide", "diet", "😀a😀", "žluť", None]
    rows = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", columns.ratio("a", "b").alias("r"), columns.quick_ratio("a", "b").alias("q"), columns.real_quick_ratio("a", "b").alias("rq"), columns.edge("a", "b", 0.5).alias("e"), columns.qualifies("a", "b", 0.5).alias("ok"), columns.ratio_capped("a", "b", 0.4).alias("cap"),
        columns.b2j_ratio("a", "b").alias("b2j"), columns.work_estimate("a", "b").alias("work"), columns.matching_stats("a", "b").alias("stats"), columns.matching_stats_cost("a", "b").alias("cost"), columns.ascii_profile("a").alias("profile")).collect()
    for x in got:
        if x.a is None or x.b is None:
            assert x.r is x.q is x.rq is x.e is x.ok is x.cap is None
            continue
        m = SequenceMatcher(None, x.a, x.b, autojunk=False)
        assert (x.r, x.q, x.rq) == (m.ratio(), m.quick_ratio(), m.real_quick_ratio())
        assert x.e == (x.r if x.r >= 0.5 else None) and x.ok == (x.r >= 0.5) and x.cap == (x.r if x.r <= 0.4 else 2.0)
        assert x.b2j == x.r and x.work == sum(x.a.count(c) * x.b.count(c) for c in set(x.a))
        stats = [max((k for k in range(end + 1) if x.a[end - k : end] in x.b), default=0) for end in range(1, len(x.a) + 1)]
        assert x.stats == stats and x.cost == sum(stats)
        assert x.profile == [*[x.a.count(chr(k)) for k in range(128)], sum(ord(c) > 127 for c in x.a)]
    counts = spark.createDataFrame([("abca😀",), ("",), (None,)], "s string").select(columns.char_counts("s").alias("c")).collect()
    assert [None if r.c is None else [(x.c, x.n) for x in r.c] for r in counts] == [[("a", 2), ("b", 1), ("c", 1), ("😀", 1)], [], None]


def test_functions_in_sql(spark):
    columns.register(spark)
    assert spark.sql("select gestalt_ratio('tide', 'diet') r").first().r == 0.25


@pytest.mark.parametrize("seed", range(4))
def test_cosine_join(spark, seed):
    draw = random.Random(seed)
    n, dims = draw.randint(5, 40), draw.randint(1, 15)
    rows = [(i, draw.randrange(dims), float(draw.randint(1, 10))) for i in range(n) for _ in range(draw.randint(0, 7))]
    vectors = {}
    for i, d, w in rows:
        vectors.setdefault(i, {}).setdefault(d, 0.0)
        vectors[i][d] += w
    for v in vectors.values():
        norm = math.sqrt(math.fsum(w * w for w in v.values()))
        for d in v:
            v[d] /= norm
    joiner = CosineJoiner.from_rows(spark.createDataFrame(rows, "id long, dim long, w double"))
    for t in (0.1, 0.5, 0.9, 1.0):
        cos = {(i, j): math.fsum(vectors[i][d] * vectors[j].get(d, 0) for d in vectors[i]) for i, j in combinations(sorted(vectors), 2)}
        want = {p: round(c, 6) for p, c in cos.items() if c >= t - 1e-9}
        assert {(r.j, r.i): round(r.cos, 6) for r in joiner.join(t).collect()} == want
        assert {(r.j, r.i): round(r.cos, 6) for r in cosine.cosine_join_bruteforce(joiner.corpus, t).collect()} == want
    c = cosine.cosine_join_counts(joiner.corpus, 0.5).first()
    assert c.candidates >= c.survivors >= c.pairs == sum(v >= 0.5 - 1e-9 for v in cos.values())
    sharing = {p for p in cos if set(vectors[p[0]]) & set(vectors[p[1]])}
    assert {(r.j, r.i) for r in joiner.join(0).collect()} == sharing
    held = {i for i, v in vectors.items() if v}
    assert {(r.j, r.i): round(r.cos, 6) for r in cosine.cosine_join_bruteforce(joiner.corpus, 0).collect()} == {p: round(c, 6) for p, c in cos.items() if set(p) <= held}


def test_cosine_join_moves_vectors_not_pairs(spark, monkeypatch):
    """A dimension that all have is held by the one vector that is nothing else, so pairs that share only it never meet."""
    rows = [(i, d, w) for i in range(300) for d, w in ((0, 1.0), (1 + i // 2, 5.0))] + [(300, 0, 1.0)]
    vectors = cosine.normalised(spark.createDataFrame(rows, "id long, dim long, w double"))
    assert cosine._meetings(vectors, 0.8).count() == 301
    monkeypatch.setattr(cosine, "BLOCK", 7)
    assert {(r.j, r.i, round(r.cos, 9)) for r in cosine.cosine_join(vectors, 0.8).collect()} == {(i, i + 1, 1.0) for i in range(0, 300, 2)}
    assert cosine.cosine_join(vectors, 0.03).count() == 301 * 150


def test_cosine_of_all_pairs_moves_vectors_a_bounded_number_of_times(spark, monkeypatch):
    """However many pairs there are, a vector goes to as many meetings as there are blocks; counts as by definition."""
    draw = random.Random(5)
    rows = [(i, d, float(draw.randint(1, 9))) for i in range(120) for d in {0, *(draw.randrange(25) for _ in range(4))}]
    vectors = cosine.normalised(spark.createDataFrame(rows, "id long, dim long, w double")).cache()
    v = {}
    for r in vectors.collect():
        v.setdefault(r.id, {})[r.dim] = r.w
    greatest = {d: max(x.get(d, 0) for x in v.values()) for d in range(25)}
    pairs_ = {(j, i): sum(w * v[i].get(d, 0) for d, w in v[j].items()) for j, i in combinations(sorted(v), 2)}
    kept, t = {}, 0.6
    for i, x in v.items():
        reach, before = 0.0, 0.0
        for d in sorted(x, key=lambda d: (greatest[d], d)):
            reach += x[d] * greatest[d]
            kept[i, d] = (reach >= t - 1e-9, math.sqrt(before))
            before += x[d] ** 2
    candidates = survivors = 0
    for j, i in pairs_:
        common = [d for d in v[j] if d in v[i] and kept[j, d][0]]
        rest = math.sqrt(sum(w * w for d, w in v[j].items() if not kept[j, d][0]))
        candidates += bool(common)
        survivors += bool(common) and sum(v[j][d] * v[i][d] for d in common) + rest * min(kept[i, d][1] for d in common) >= t - 1e-9
    want = (candidates, survivors, sum(c >= t - 1e-9 for c in pairs_.values()))
    for blocks in (1, 4):
        monkeypatch.setattr(cosine, "BLOCKS", blocks)
        assert cosine._block_pairs(cosine.indexed(vectors, t)).count() == 120 * blocks
        assert tuple(cosine.cosine_join_counts(vectors, t).first()) == want
        found = {(r.j, r.i): r.cos for r in cosine.cosine_join_bruteforce(vectors, t).collect()}
        assert found.keys() == {p for p, c in pairs_.items() if c >= t - 1e-9} and all(abs(c - pairs_[p]) < 1e-9 for p, c in found.items())


def test_token_documents(spark):
    docs = spark.createDataFrame([(0, "salt\npepper and oil"), (1, "salt\npepper and oil"), (2, "bread\nolives"), (3, None)], "id long, text string")
    got = CosineJoiner.from_token_docs(docs, "id", F.split("text", "\n")).join(0.8).collect()
    assert [(r.j, r.i, round(r.cos, 9)) for r in got] == [(0, 1, 1.0)]


def test_handles(spark):
    for name in BACKENDS:
        assert Rationer(name.upper()).concurrency == "cpu"
    with pytest.raises(ValueError):
        Rationer("tpu")
    assert Rationer(delta=7).delta == 1.0
    df = spark.createDataFrame([(0, "tide"), (1, "diet")], "idx long, text string")
    held = Rationer().prepare(df)
    assert len(held) == 2 and not held.is_empty()
    ask = spark.createDataFrame([(0, 1), (1, 0), (0, 1)], "i long, j long")
    assert sorted((r.i, r.j, r.ratio) for r in held.ratio_many_idx(ask).collect()) == [(0, 1, 0.25), (0, 1, 0.25), (1, 0, 0.5)]
    with pytest.raises(IndexError):
        held.ratio_many_idx(spark.createDataFrame([(0, 9)], "i long, j long"))
    many = Rationer(threads=3).ratio_many(spark.createDataFrame([("tide", "diet")] * 3, "a string, b string"))
    assert [r.ratio for r in many.collect()] == [0.25] * 3


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 20)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(40)]
    draw.shuffle(edges)
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    df = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == least
    assert connected_components(df.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "c.bin").write_bytes(b"one\0\0two \xff\0three")
    assert sorted(r.text for r in corpora.read_nul_separated(spark, str(tmp_path / "c.bin")).collect()) == ["one", "three", "two �"]
    assert corpora.read_nul_separated(spark, str(tmp_path / "c.bin"), 2).count() == 2
    rows = [[(1, 0.5), (7, 2.0)], [], [(3, 1.0)]]
    raw = struct.pack("<QII", corpora.SPARSE_MAGIC, len(rows), 0) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<If", *e) for e in r) for r in rows)
    (tmp_path / "s.bin").write_bytes(raw)
    got = corpora.read_sparse_rows(spark, str(tmp_path / "s.bin")).collect()
    assert sorted((r.id, r.dim, r.w) for r in got) == [(0, 1, 0.5), (0, 7, 2.0), (2, 3, 1.0)]
    z = corpora.zipf_rows(spark, 400)
    assert z.count() == 400 * 14 and z.agg(F.min("w")).first()[0] > 0
    held = {}
    for r in z.collect():
        held.setdefault(r.id, []).append(r.dim)
    alike = sum(len(set(held[i]) & set(held[i - 1])) >= 11 for i in range(1, 400))
    assert 8 <= alike <= 40  # about one row in twenty is a near copy of the one before
    assert [tuple(r) for r in corpora.from_list(spark, ["b", "", "a"]).collect()] == [(0, "b"), (1, ""), (2, "a")]
    assert corpora.from_list(spark, []).count() == 0
    kept = [r.text for r in corpora.read_nul_separated(spark, str(tmp_path / "c.bin"), sample=2, seed=5).collect()]
    assert kept == [r.text for r in corpora.read_nul_separated(spark, str(tmp_path / "c.bin"), sample=2, seed=5).collect()] and len(kept) == 2
    (tmp_path / "d.bin").write_bytes("x\ud83dy".encode("utf-8", "surrogatepass"))
    passed = corpora.read_nul_separated(spark, str(tmp_path / "d.bin"), errors="surrogatepass")
    assert passed.select(F.length("text"), F.octet_length("text")).first()[:] == (3, 5)
    with pytest.raises(ValueError):
        corpora.read_nul_separated(spark, str(tmp_path / "d.bin"), errors="ignore")
    corpora.write_sparse_file(spark, [[(4, 0.5)], []], str(tmp_path / "w.bin"))
    assert [(r.id, r.dim, r.w) for r in corpora.read_sparse_rows(spark, str(tmp_path / "w.bin")).collect()] == [(0, 4, 0.5)]
    corpora.write_nul_separated(spark.createDataFrame([("p q",), ("r\ns",), (None,)], "text string"), str(tmp_path / "out"))
    assert sorted(r.text for r in corpora.read_nul_separated(spark, str(tmp_path / "out")).collect()) == ["p q", "r\ns"]
