"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import os
import random

import corpus_pipeline
import numpy as np
import pytest

from quillmatch.llm import ngram_join, quality_model
from test_llm_operators import awkward, brute_classes, brute_removal, library_ids

SF = os.environ.get("PIPELINE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.written(stage(spark, kept[-1], SF), "test"))
        assert kept[-1].columns == columns
    rows = [sorted((r.doc_id, r.text) for r in d.collect()) for d in kept]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) > 0.7 * len(rows[0])
    classes = brute_classes(rows[1])
    assert rows[2] == [(k, x) for k, x in rows[1] if classes[k][1] == k]
    want = brute_removal(rows[2])
    assert rows[3] == [(k, want[k][2] if want[k][1] else x) for k, x in rows[2]]
    assert rows[4] == rows[3]
    name, last = corpus_pipeline.STAGES[-1]
    got = {r.doc_id: tuple(r) for r in last(spark, kept[-1], SF).collect()}
    ids = library_ids(corpus_pipeline._vocabulary(), [x or "" for _, x in rows[4]])
    for (k, x), i in zip(rows[4], ids):
        assert got[k] == (k, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(got.values())
    assert np.all([isinstance(k, str) and callable(f) for k, f in corpus_pipeline.STAGES])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def labels_dir(spark, tmp_path, ids):
    spark.createDataFrame([(k, k % 2, 0) for k in ids], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    sf = labels_dir(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, sf)
        assert out.count() == 0 and out.columns == empty.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in every column, ids on two texts, repeated rows, and a very long text."""
    texts = awkward(9, 70)
    rows = [(k, x, "en" if k % 2 else None, f"s{k % 3}" if k % 5 else None, len(x or "") if k % 4 else None) for k, x in texts]
    rows += [(None, texts[20][1], None, None, None), (None, None, None, None, None), (3, "another text of the same id than before is this one here", "en", "s1", 9), rows[30], rows[30]]
    docs = spark.createDataFrame(rows, COLUMNS)
    sf = labels_dir(spark, tmp_path, [k for k, _ in texts if k])
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    first, second, third, fourth, last = (f for _, f in corpus_pipeline.STAGES)

    kept = plain(first(spark, docs, sf))
    model = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {(r.doc_id, r.n_chars, r.predicted) for r in quality_model.score(docs, model, keep=("doc_id", "n_chars")).collect()}
    assert all((r[0], r[4], 1) in good for r in kept) and set(kept) <= set(rows)

    # classes by position, so that each row is judged by its own text; those without an id have no smaller one to copy
    classes = brute_classes(list(enumerate(r[1] for r in rows)))
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[classes[k][1]] = min(least.get(classes[k][1], r[0]), r[0])
    want = [r for k, r in enumerate(rows) if r[0] is None or not classes[k][0] or least[classes[k][1]] == r[0]]
    assert plain(second(spark, docs, sf)) == sorted(want, key=str)

    cut = plain(third(spark, docs, sf))
    assert len(cut) == len(rows) and [r[:1] + r[2:] for r in cut if r[0] is None] == [r[:1] + r[2:] for r in sorted((r for r in rows if r[0] is None), key=str)]
    single = [(k, x) for k, x in texts if k != 3 and (k, x) != texts[30]]
    removal = brute_removal([(r[0], r[1]) for r in rows if r[0] is not None and r[0] != 3])
    for k, x in single:
        assert (removal[k][2] if removal[k][1] else x) in [r[1] for r in cut if r[0] == k]

    assert plain(fourth(spark, docs, sf)) == sorted(rows, key=str)

    ids = library_ids(corpus_pipeline._vocabulary(), [r[1] or "" for r in rows])
    want = sorted(((r[0], len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(rows, ids)), key=str)
    assert plain(last(spark, docs, sf)) == want


def test_near_copies_make_few_links(spark, tmp_path, monkeypatch):
    """The join's stage on a class of near copies: one document of each class, without a row for each pair that links."""
    made, walked = [], ngram_join._walked

    def counted(open_, sets, percent):
        links = walked(open_, sets, percent)
        made.append((links.count(), open_.count()))
        return links

    monkeypatch.setattr(ngram_join, "_walked", counted)
    draw, rows = random.Random(4), []
    for k in range(240):
        w = [f"w{j}" for j in range(80)]
        for _ in range(draw.randint(1, 3)):
            w[draw.randrange(80)] = f"x{draw.randrange(10_000)}"
        rows.append((k, " ".join(w), "en", "s1", None))
    left = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, spark.createDataFrame(rows, COLUMNS), str(tmp_path))
    classes = brute_classes([r[:2] for r in rows])
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in classes.values()})
    assert made and all(links < sets for links, sets in made)
