"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmatch.llm import bitmap, bpe, frequency, kernel, language_id, mixing, ngram_join, quality_model, quality_rules, simhash, substrings, token_files, toxicity, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside.
EXTRA = ("n", "t", "w", "m", "a", "b", "h", "node", "score", "_row", "_keep", "_doc", "_text", "_kept", "_words")


@pytest.fixture(scope="module")
def vocab_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def table(spark, rows):
    """``rows`` of (doc_id, text) with further columns of clashing names, all null."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), *[F.lit(None).cast("string").alias(c) for c in EXTRA])


def awkward(seed=1, n=60):
    """Near and exact copies, shared passages, empty, null, separator-only and long texts."""
    draw = random.Random(seed)
    vocab = ["".join(draw.choice("abcdeéŽ字") for _ in range(draw.randint(1, 6))) for _ in range(80)]
    text = lambda k: draw.choice((" ", "\n", "  ")).join(draw.choice(vocab) for _ in range(k))
    passage, out = text(70), [None, "", " \t\n", "a", "a b c", "A b C", "x y z w v", "a  b c"]
    while len(out) < n:
        kind = draw.random()
        if kind < 0.2:
            out.append(draw.choice([x for x in out if x]))
        elif kind < 0.5:
            words = (draw.choice([x for x in out if x])).split(" ")
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocab)
            out.append(" ".join(words))
        elif kind < 0.7:
            out.append(f"{text(draw.randint(0, 30))} {passage} {text(draw.randint(0, 30))}")
        else:
            out.append(text(draw.randint(1, 120)))
    out.append(text(6000) + " " + passage)
    return [(k * 3, x) for k, x in enumerate(out)]


def words(text):
    return WORD.findall(text or "")


# --- kernels ---------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = [x for _, x in awkward()]
    seen, k = {}, 0
    for s in kernel.slices(pa.array(texts), 400):
        h = s.word_hashes(1)
        for j, row in enumerate(s.rows):
            a, b = s.first[j], s.first[j + 1]
            got = [s.data[x:y].tobytes().decode() for x, y in zip(s.starts[a:b], s.ends[a:b])]
            assert got == words(texts[row])
            for w, x in zip(got, h[a:b].tolist()):
                assert seen.setdefault(x, w) == w
            k += 1
    assert k == len(texts) and len(set(seen.values())) == len(seen)


def test_bitmap_misses_nothing(spark):
    keys = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63, 3000)]
    made = bitmap.bitmap_of(spark.createDataFrame([(k,) for k in keys], "k long"), "k", len(keys))
    assert made.has(np.array(keys).view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    assert made.has(others).mean() < 0.02
    assert not bitmap.bitmap_of(spark.createDataFrame([], "k long"), "k", 0).has(others).any()


# --- op1 -------------------------------------------------------------------------------------------------------------


def brute_rules(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), base


def test_quality_rules(spark):
    rows = awkward() + [(1000, "a b c d e f g h " * 5), (1001, "x\nx\ny\n \n \nx # | <"), (None, "a"), (1001, "again")]
    got = quality_rules.score(table(spark, rows), keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(r.text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.score(table(spark, [])).count() == 0


# --- op2, op5, op6 ---------------------------------------------------------------------------------------------------


def test_lexicon_automaton_is_edit_distance():
    terms = {"idiot": 3.0, "moron": 2.0, "scum": 1.5, "loser": 2.5, "foul*": 4.0}
    lexicon = toxicity.Lexicon(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[:], i
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    draw = random.Random(4)
    tried = ["idiot", "idiott", "idot", "1diot", "moron", "m0ron", "scum", "scun", "fouls", "foulness", "fuol", ""]
    for _ in range(800):
        w = list(draw.choice(["idiot", "moron", "scum", "loser", "foul"]))
        for _ in range(draw.randint(0, 3)):
            k = draw.randint(0, len(w))
            w[k : k + draw.randint(0, 1)] = draw.choice(["", "x", "o", "s"])
        tried.append("".join(w))
    for w in tried:
        exact = max([v for t, v in terms.items() if t == w or (t.endswith("*") and w.startswith(t[:-1]))], default=0.0)
        fuzzy = 0.0 if exact else max([v for t, v in terms.items() if not t.endswith("*") and len(t) >= 5 and distance(w, t) == 1], default=0.0)
        assert lexicon.match(w) == (exact, fuzzy), w


def labelled_corpus(seed, n=400):
    draw = random.Random(seed)
    vocab = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(200)]
    rows, labels = [], []
    for k in range(n):
        toxic, bad = draw.random() < 0.3, draw.random() < 0.3
        w = [draw.choice(vocab) for _ in range(draw.randint(10, 60))]
        if toxic:
            for _ in range(3):
                w.insert(draw.randint(0, len(w)), draw.choice(["wretch", "vermin", "lout"]))
        if bad:
            w = [x + draw.choice(("###", "$$$", "|")) for x in w]
        rows.append((k, " ".join(w)))
        labels.append((k, int(not bad), int(toxic)))
    return rows, labels


def test_fitted_scores(spark):
    rows, labels = labelled_corpus(3)
    docs = table(spark, [*rows, (None, "wretch"), (9000, None), (9001, ""), (5, rows[5][1])])
    marks = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1), (123456, 0, 1)], "doc_id long, quality int, toxic int")
    truth = {k: (q, t) for k, q, t in labels}
    held = {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    for which, scored in ((0, quality_model.score(docs, quality_model.fit(docs, marks))), (1, toxicity.score(docs, toxicity.fit(docs, marks)))):
        got = scored.collect()
        assert len(got) == len(rows) + 4
        known = [r for r in got if r.doc_id in truth]
        assert all(r.held_out == (r.doc_id in held) for r in known)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if which else 0.3)) for r in got)
        tested = [r for r in known if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][which] for r in tested) >= 0.95 * len(tested)
        assert len({r.score for r in got if r.doc_id == 5}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect())
    assert {r.predicted for r in quality_model.score(docs, quality_model.fit(docs, none)).collect()} == {1}
    assert quality_model.good(docs, quality_model.fit(docs, none)).columns == docs.columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(
    "text, quoted",
    [
        ('he is "scum" here', True), ("he is “scum”, here", True), ("they called him scum", True), ("he said that scum", True),
        ('she "was such scum again" there', True), ("he is scum here", False), ('he is "nice" but scum', False),
        ("said one two three four scum", False), ('an "open mark and scum', False), ("scum", False),
    ],
)
def test_quotations(text, quoted):
    words = text.encode().split()
    at = next(k for k, w in enumerate(words) if b"scum" in w)
    assert toxicity.Scorer._quoted(words, at) == quoted


def test_toxicity_scores_are_those_of_the_definition(spark):
    """Features from edit distances to every term, sums over hits and windows by the plain rule; then the logistic score."""
    terms = {"wretch": 2.0, "scumbag": 3.0, "vile*": 1.5, "bad": 1.0}
    weights = np.array([-1.0, 0.7, 0.5, -0.4, 0.2, 0.3, 0.1])
    model = toxicity.Scorer(toxicity.Lexicon(terms), weights)
    draw = random.Random(12)
    pool = ["wretch", "wretsh", "wrettch", "wrech", "Scumbag!", "scumbg", "vileness", "vil", "bad", "bed", "fine", "words", "said", '"bad"', "“wretch”", "and", "so", "it", "is"]
    rows = [(k, " ".join(draw.choice(pool) for _ in range(draw.randint(0, 60)))) for k in range(80)] + [(200, None), (201, ""), (202, "fine words " * 3000 + "wretch")]

    def hit(word):
        w = toxicity.plain_word(word.encode())
        exact = max([v for t, v in terms.items() if (w.startswith(t[:-1]) if t[-1] == "*" else w == t)], default=0.0)
        fuzzy = max([v for t, v in terms.items() if t[-1] != "*" and len(t) >= toxicity.FUZZY_LETTERS and distance(w, t) == 1], default=0.0)
        return exact, 0.0 if exact else fuzzy

    def score(text):
        ws = (text or "").split()
        value = [sum(hit(w)) for w in ws]
        x = np.zeros(6)
        if any(value):
            sums = [0.0, 0.0, 0.0]
            for k, w in enumerate(ws):
                e, f = hit(w)
                if value[k] and toxicity.Scorer._quoted([y.encode() for y in ws], k):
                    sums[2] += e + f
                else:
                    sums[0] += e
                    sums[1] += f
            densest = max(sum(value[max(0, k - toxicity.CONTEXT + 1) : k + 1]) for k in range(len(ws)))
            x = np.log1p([*sums, 100 * sum(value) / len(ws), densest, max(value)])
        return 1 / (1 + np.exp(-(weights[0] + x @ weights[1:])))

    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, text in rows:
        assert abs(got[k].score - score(text)) < 1e-9 and got[k].predicted == int(got[k].score >= 0.5)


def test_lexicon_of_very_many_terms(spark):
    """Shared words beyond any number of candidates do not crowd the terms out."""
    common = [f"w{k:05d}" for k in range(60_000)]
    rows = [(k, " ".join(common) + " grumbletoxin" * (k % 2), k % 2) for k in range(40)]
    made = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert any(t.startswith("grum") for t in made.terms) and not any(t.startswith("w0") for t in made.terms)


def test_rule_columns_agree_with_the_rules(spark):
    rows, labels = labelled_corpus(8, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_model.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    stats = quality_model.statistics(docs).toPandas()
    values = {n: stats[f"_s_{n}"].to_numpy() for n in quality_model.STATISTICS}
    want = 1 / (1 + np.exp(-(model.intercept + sum(w * r.holds(values) for r, w in model.weights))))
    got = quality_model.score(docs, model).toPandas().set_index("doc_id").score
    assert np.allclose(got[stats.doc_id].to_numpy(), want)


def test_language_models(spark):
    draw = random.Random(2)
    parts = {"xx": ["la", "mi", "ro"], "yy": ["kst", "ung", "ach"], "zz": ["éa", "ßo", "ñi"]}
    rows = []
    for k in range(300):
        lang = draw.choice(list(parts))
        rows.append((k, " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(5, 40))).capitalize(), lang))
    rows += [(500, None, "xx"), (501, "123 ...", "xx"), (502, "", None), (503, "lami roro", None), (None, "lamila", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out_row(3, 1))
    model = language_id.fit(docs.where("not held_out"))
    got = {r.doc_id: r for r in language_id.identify(docs, model, ("doc_id", "held_out")).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:300])
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows[:300])
    assert [got[k].lang_pred for k in (500, 501, 502, 503)] == ["und", "und", "und", "xx"]
    assert all(0 <= r.score <= 1 for r in got.values())
    probabilities = [np.exp(model.models.word_scores([x])[0][0]) for x in ("la", "mi")]
    assert all((p < 1).all() and (p > 0).all() for p in probabilities)
    nothing = language_id.fit(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_language_models_have_all_counts(spark, monkeypatch):
    """Spark's tables are those of all n-grams, whatever their number; none is left out before discounts are taken."""
    draw = random.Random(4)
    rows = [(f"l{k % 3}", " ".join("".join(draw.choice("abcdeéß字") for _ in range(draw.randint(1, 7))) for _ in range(8))) for k in range(90)]
    rows += [("rare", "zq qz"), (None, "a"), ("l1", None), ("l1", "...")]
    train = spark.createDataFrame(rows, "lang string, text string")
    counts = language_id.count_grams(train.where("lang is not null and text is not null")).toPandas()
    want = language_id.Models(counts)
    monkeypatch.setattr(language_id, "PIECE", 300, raising=False)
    got = language_id.fit(train).models
    assert got.langs == want.langs and got.uniform == want.uniform
    for a, b in zip([*got.grams, *got.contexts], [*want.grams, *want.contexts]):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])


def test_language_calibration_is_of_every_training_row(spark, monkeypatch):
    """The score and the limits are those of all training rows, however many, and each text is scored once."""
    draw = random.Random(12)
    parts = {"xx": ["la", "mi", "ro", "ung"], "yy": ["kst", "ung", "ach", "mi"]}
    rows = []
    for k in range(9000):
        lang = "yy" if k % 9 == 0 else "xx"
        rows.append((k, " ".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 4))) + (f" {draw.choice('qxjw') * 3}" if k % 50 == 0 else ""), lang))
    docs = spark.createDataFrame([*rows, (None, None, "xx"), (9001, "...", "xx")], "doc_id long, text string, lang string").withColumn("held_out", language_id.held_out_row(3, 1))
    train, seen = docs.where("not held_out"), []
    calibrate = language_id.Identifier.calibrate

    def counted(self, measures):
        seen.append(measures.where("n > 0 and lang is not null").count())
        calibrate(self, measures)

    monkeypatch.setattr(language_id.Identifier, "calibrate", counted)
    model = language_id.fit(train)
    got = sorted(map(tuple, language_id.learn_and_identify(docs, ~docs["held_out"], ("doc_id", "lang")).collect()), key=str)
    assert got == sorted(map(tuple, language_id.identify(docs, model, ("doc_id", "lang")).collect()), key=str)
    used = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    assert seen == [len(used)] * 2
    entropy, n = language_id.Scorer(model.models).batch([t.encode() for t, _ in used])
    best, lowest, lead = model.features(entropy, n)
    truth = np.array([model.models.langs.index(lang) for _, lang in used])
    for k in range(2):
        assert abs(model.limits[k] - np.quantile(lowest[best == k], 0.995, method="inverted_cdf")) <= 2 / language_id.STEPS
    each = np.bincount(truth)
    exact = language_id.ridge(np.log1p(lead)[:, None], (best == truth).astype(float), counts=np.minimum(1, each.mean() / each)[truth])
    assert np.allclose(model.weights, exact, atol=0.02)


def small_models(seed, letters="abcdeéß字"):
    import pandas as pd

    draw, grams = random.Random(seed), Counter()
    for _ in range(300):
        padded = language_id.START * 4 + "".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) + language_id.END
        for k in range(len(padded) - 4):
            grams[draw.choice("xy"), padded[k : k + 5]] += 1
    return language_id.Models(pd.DataFrame([(*g, n) for g, n in grams.items()], columns=["lang", "gram", "n"]))


def test_language_scores_look_up_each_gram_once(monkeypatch):
    """Many new words of few n-grams need few look-ups in the models, not some for every character."""
    draw, models = random.Random(3), small_models(6, "abc")
    texts = [" ".join("".join(draw.choice("abc") for _ in range(draw.randint(8, 16))) for _ in range(400)).encode() for _ in range(20)]
    assert len({w for t in texts for w in t.split()}) > 7000
    asked, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **more: asked.append(np.size(v)) or plain(a, v, *rest, **more))
    scorer = language_id.Scorer(models)
    scorer.batch(texts)
    assert sum(asked) <= 10 * 4**5 + len(texts)
    asked.clear()
    scorer.batch(texts)
    assert sum(asked) <= len(texts)


def test_language_scores_are_sums_over_the_words(monkeypatch):
    """Odd texts, long ones and more n-grams than are remembered: the sum over each word's letters, one word after another."""
    draw, models = random.Random(7), small_models(9)
    odd = "abcAÉéß字Σσςİıŉǰﬁᾼ𐐀 1.'’\u0301\u00ad\ufffd\x02\x03\x1c\u00a0\u2028" + " \n\t\x0b\x0c\r" * 2
    texts = ["".join(draw.choice(odd) for _ in range(draw.randint(0, 80))).encode() for _ in range(300)]
    texts += [b"", b" ", b"...", b"\xe5\xad \xff\xc3 a", "aΣ".encode() * 300, ("ΑΣ. " * 300).encode(), b"a" * 2000 + b" \n\n " + b"b c " * 400]
    monkeypatch.setattr(language_id, "PIECE_BYTES", 500, raising=False)
    monkeypatch.setattr(language_id.Scorer, "LIMIT", 100)
    scorer = language_id.Scorer(models)
    got, n = scorer.batch(texts)
    alone = [language_id.Scorer(models).batch([t]) for t in texts]
    assert np.array_equal(got, np.concatenate([a[0] for a in alone])) and n.tolist() == [int(a[1][0]) for a in alone]
    for t, entropy, count in zip(texts, got, n):
        plain = ["".join(filter(str.isalpha, w.decode("utf-8", "replace").lower())) for w in t.split()]
        plain = [w for w in plain if w]
        assert count == sum(len(w) + 1 for w in plain)
        if plain:
            assert np.allclose(entropy, -models.word_scores(plain)[0].sum(axis=0) / count, rtol=1e-12)
        else:
            assert not entropy.any()


def test_language_numbers():
    """Hashes get the numbers in which they were added, whatever slots they share."""
    draw = np.random.default_rng(2)
    numbers, known = language_id.Numbers(), np.empty(0, np.uint64)
    for size in (1, 1500, 1500, 20_000):
        # many of a few low bits, and 0
        new = np.setdiff1d(draw.integers(0, 1 << 50, size, dtype=np.uint64) << np.uint64(draw.integers(0, 12)), known)
        new = new if len(known) else np.zeros(1, np.uint64)
        assert (numbers.find(new) == -1).all()
        numbers.add(new)
        known = np.concatenate([known, new])
        assert numbers.find(known).tolist() == list(range(len(known)))


class PlainKneserNey:
    """The definition, with dictionaries: one language, from counts of the longest n-grams."""

    def __init__(self, grams):
        self.tables = {language_id.ORDER: dict(grams)}
        for k in range(language_id.ORDER - 1, 0, -1):
            self.tables[k] = Counter(g[1:] for g in self.tables[k + 1])
        self.alphabet = {c for g in grams for c in g} - {language_id.START}
        self.unknown = 1 / (len({c for g in grams for c in g}) + 1)

    def of(self, context, c):
        p = self.unknown
        for k in range(1, language_id.ORDER + 1):
            h = context[len(context) - k + 1 :] if k > 1 else ""
            after = {g[-1]: n for g, n in self.tables[k].items() if g[:-1] == h}
            total = sum(after.values())
            if total:
                once, twice = (sum(n == x for n in self.tables[k].values()) for x in (1, 2))
                d = min(0.95, max(0.1, once / (once + 2 * twice) if once + twice else 0.5))
                p = max(after.get(c, 0) - d, 0) / total + d * len(after) / total * p
        return p


def test_kneser_ney_is_the_definition_and_sums_to_one():
    import pandas as pd

    draw, grams = random.Random(5), Counter()
    for w in ("abc", "abd", "bca", "abcab", "c", "dda"):
        padded = language_id.START * 4 + w + language_id.END
        for k in range(len(w) + 1):
            grams[padded[k : k + 5]] += draw.randint(1, 3)
    made = language_id.Models(pd.DataFrame([("x", g, n) for g, n in grams.items()], columns=["lang", "gram", "n"]))
    plain = PlainKneserNey(grams)
    for w in ("abc", "abd", "cab", "dddd", "q", "aq", "bcabca"):
        padded = language_id.START * 4 + w + language_id.END
        want = sum(np.log(plain.of(padded[k : k + 4], padded[k + 4])) for k in range(len(w) + 1))
        scores, sizes = made.word_scores([w])
        assert abs(scores[0][0] - want) < 1e-4 and sizes[0] == len(w) + 1
    start = language_id.START
    for context in (start * 4, start * 3 + "a", start + "abc", "abca", "dddd"):
        # START is never predicted; the rest of the uniform share is that of unknown characters and of START
        known = sum(plain.of(context, c) for c in plain.alphabet)
        assert abs(known + 2 * plain.of(context, "?") - 1) < 1e-9


def test_language_choice_and_rejection(spark):
    """The language of the lowest cross-entropy, as the definition has it; strange texts are rejected, usual ones are not."""
    draw = random.Random(8)
    parts = {"xx": ["la", "mi", "ro"], "yy": ["kst", "ung", "ach"]}
    text = lambda lang: " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(draw.randint(5, 30)))
    train = [(k, text(lang), lang) for k in range(200) for lang in parts]
    train += [(1000, "mila lari", "zz")]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    asked = [(k, text(draw.choice(list(parts)))) for k in range(60)] + [(100 + k, " ".join("".join(draw.choice("qxjwvzf") for _ in range(9)) for _ in range(20))) for k in range(20)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    plain = {}
    for lang in model.models.langs:
        grams = Counter()
        for _, t, own in train:
            if own == lang:
                for w in t.split():
                    padded = language_id.START * 4 + w + language_id.END
                    for k in range(len(w) + 1):
                        grams[padded[k : k + 5]] += 1
        plain[lang] = PlainKneserNey(grams)
        plain[lang].unknown = model.models.uniform
    for k, t in asked[:12]:
        entropy = {}
        for lang, p in plain.items():
            padded = [language_id.START * 4 + w + language_id.END for w in t.split()]
            each = [np.log(p.of(w[k : k + 4], w[k + 4])) for w in padded for k in range(len(w) - 4)]
            entropy[lang] = -np.mean(each)
        assert got[k].lang_pred == min(entropy, key=entropy.get)
    assert sum(got[k].rejected for k in range(60)) <= 3
    assert all(got[100 + k].rejected for k in range(20))


# --- op3 -------------------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for k, x in rows:
        w = re.sub("[A-Z]", lambda c: c.group().lower(), x or "")
        w = words(w)
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rows = awkward(seed, 110)
    got = ngram_join.classes(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows)


def test_ngram_join_of_a_large_class(spark):
    """A class of near copies of which many pairs do not link is still one class, beside a passage that all share."""
    draw = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = base[:]
        for _ in range(draw.randint(0, 4)):
            w[draw.randrange(120)] = f"x{draw.randrange(1000)}"
        rows.append((k, " ".join(w)))
    for k in range(150, 200):
        rows.append((k, " ".join([*base[:40], *[f"y{draw.randrange(5000)}" for _ in range(100)]])))
    got = ngram_join.classes(table(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows)


@pytest.mark.parametrize("block", [600, 60])
def test_ngram_join_of_a_large_class_makes_few_links(spark, monkeypatch, block):
    """Near copies that the first step leaves apart: the walk gives fewer links than it gets sets, not one for each pair."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    made, walked = [], ngram_join._walked

    def counted(open_, sets, percent):
        links = walked(open_, sets, percent)
        made.append((links.count(), open_.count()))
        return links

    monkeypatch.setattr(ngram_join, "_walked", counted)
    draw, base, rows = random.Random(4), [f"w{k}" for k in range(80)], []
    for k in range(240):
        w = base[:]
        for _ in range(draw.randint(1, 3)):
            w[draw.randrange(80)] = f"x{draw.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert made and all(0 < links < sets for links, sets in made)


def test_forest_joins_what_all_links_join():
    draw = np.random.default_rng(5)
    for _ in range(40):
        size = int(draw.integers(2, 40))
        base = np.arange(40, dtype=np.uint64)
        sets = sorted((np.sort(draw.permutation(base)[: draw.integers(25, 41)]) for _ in range(size)), key=list)
        n, c, block = np.array([len(x) for x in sets]), draw.integers(0, 12, size), draw.integers(0, 2, size)
        for blocks in (None, block):
            links = [(i, j) for i in range(size) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j])) and (blocks is None or block[i] != block[j])]
            p, q = ngram_join._forest(trie.Trie(sets, n), n, c, blocks, 75)
            assert {(max(e), min(e)) for e in zip(p.tolist(), q.tolist())} <= set(links)
            joined = []
            for edges in (links, list(zip(p.tolist(), q.tolist()))):
                label = c.copy()
                for i, j in edges:
                    label[label == label[i]] = label[j]
                joined.append([np.flatnonzero(label == x)[0] for x in label])
            assert joined[0] == joined[1]
            assert len(p) == len(set(c.tolist())) - len(set(joined[1]))


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.classes(table(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (0, "q")]
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in ngram_join.classes(table(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 1, 1), (False, 1, 1), (True, None, 1), (False, 2, 2), (False, 3, 3), (False, 0, 0)], key=str)
    left = ngram_join.one_of_each(table(spark, [(5, "a b c d e f"), (9, "A b c d e f"), (7, None)]))
    assert sorted(r.doc_id for r in left.collect()) == [5, 7] and set(EXTRA) <= set(left.columns)


def test_one_of_each_judges_rows_by_their_own_text(spark):
    """One id on two texts, null ids, repeated rows and an empty table: nothing is lost that has no double."""
    copied, alone = "b1 b2 b3 b4 b5 b6 b7 b8", "u1 u2 u3 u4 u5 u6 u7 u8"
    rows = [(2, copied), (5, alone), (5, copied), (None, copied), (None, "v1 v2"), (8, ""), (8, None), (9, alone), (9, alone), (4, "w w w w w w"), (4, "w w w w w w")]
    left = [tuple(r) for r in ngram_join.one_of_each(table(spark, rows)).select("doc_id", "text").collect()]
    assert sorted(left, key=str) == sorted([(2, copied), (5, alone), (None, copied), (None, "v1 v2"), (8, ""), (8, None), (4, "w w w w w w"), (4, "w w w w w w")], key=str)
    assert ngram_join.one_of_each(table(spark, [])).count() == 0
    assert ngram_join.one_of_each(table(spark, [(None, None), (None, "")])).count() == 2


@pytest.mark.parametrize("block", [600, 7])
def test_ngram_join_of_many_texts_just_below_the_threshold(spark, monkeypatch, block):
    """A shingle that very many different components share: its sub-trie is walked, also in blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    draw, base, rows = random.Random(1), [f"w{k}" for k in range(60)], []
    for k in range(220):
        w = base[:]
        for _ in range(draw.randint(0, 6)):
            w[draw.randrange(60)] = f"x{draw.randrange(40)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(table(spark, rows)).collect()}
    assert got == brute_classes(rows) and len({c for _, c in got.values()}) > 100


def test_trie_counts_overlaps():
    draw = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.sort(draw.choice(40, draw.integers(0, 25), replace=False)).astype(np.uint64) for _ in range(draw.integers(1, 40))]
        sets.sort(key=lambda x: x.tolist())
        sizes = np.array([len(x) + int(draw.integers(0, 4)) for x in sets])
        made = trie.Trie(sets, sizes)
        for probe in sets[:8]:
            size = len(probe) + int(draw.integers(0, 4))
            for percent in (20, 75):
                want = []
                for k, x in enumerate(sets):
                    both = len(np.intersect1d(x, probe))
                    if 100 * both >= percent * (size + sizes[k] - both):
                        want.append(k)
                assert made.linked(made.places(probe), size, percent).tolist() == want
    assert trie.Trie([], np.zeros(0, int)).linked(np.zeros(0, int), 3, 75).tolist() == []


@pytest.mark.parametrize("size", [0, 1, 5000])
def test_frequency_classes(size):
    """Runs are unpacked as they were, and no class is too low."""
    draw = np.random.default_rng(size)
    pool = draw.integers(0, 2**64, max(1, size // 6), dtype=np.uint64)
    hashes = draw.choice(pool, size) if size else np.zeros(0, np.uint64)
    hashes = np.concatenate([hashes, np.repeat(pool[:1], 3 * size)])
    by_bucket: dict = {}
    for part in np.array_split(hashes, 3):
        for bucket, run in zip(*frequency.runs(part, 6)):
            by_bucket.setdefault(bucket, []).append(frequency.unpacked(bucket, run, 6))
    assert sorted(np.concatenate([x for v in by_bucket.values() for x in v] or [hashes])) == sorted(hashes >> np.uint64(16))
    levels = frequency.Levels({k: frequency.segments(np.concatenate(v), 6) for k, v in by_bucket.items()}, 6)
    values, counts = np.unique(hashes, return_counts=True)
    want = np.searchsorted(frequency.FREQUENCIES, counts, side="right")
    got = levels.of(values)
    assert (got >= want).all() and (got == want).mean() > 0.98 if len(values) else not len(got)
    others = draw.integers(0, 2**64, 2000, dtype=np.uint64)
    assert (levels.of(others) > 0).mean() < 0.02


# --- op4 -------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark):
    rows = awkward(3, 50)
    got = {r.doc_id: r for r in simhash.edited(table(spark, rows)).collect()}
    texts = [x or "" for _, x in rows]
    by_text = {}
    for k, (i, _) in enumerate(rows):
        x, nxt = texts[k], texts[(k + 1) % len(texts)]
        q = len(x) // 4
        edit = x[: len(x) - q] + nxt[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edit.encode()).hexdigest())
        apart = (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count()
        assert r.near_edited == 1 - apart / 128 and len(r.fingerprint) == 32
        assert r.near_next == 1 - (int(r.fingerprint, 16) ^ int(got[rows[(k + 1) % len(rows)][0]].fingerprint, 16)).bit_count() / 128
        assert by_text.setdefault(x, r.fingerprint) == r.fingerprint
    assert simhash.edited(table(spark, [])).count() == 0
    alone = simhash.edited(table(spark, [(4, "a b c d")])).first()
    assert alone.near_next == 1.0
    assert simhash.edited(table(spark, [(None, "a"), (None, None), (2, "b"), (2, "b")])).count() == 4


def test_fingerprint_bits_by_votes(spark):
    """Every bit from a plain count of votes over the terms that a regular expression cuts."""
    rows = awkward(4, 40)
    got = {r.doc_id: r.f for r in simhash.fingerprint(table(spark, rows), {"text": "f"}).collect()}
    for k, text in rows:
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
        width = min(3, len(spans))
        votes = [0] * 128
        for i in range(len(spans) - width + 1 if spans else 0):
            a, b = spans[i][0], spans[i + width - 1][1]
            term = next(iter(kernel.slices(pa.array([(text or "").encode()[a:b].decode()]))))
            words = term.word_hashes(1)
            bits = "".join(f"{int(kernel.run_hashes(words, np.array([0]), np.array([width]), seed)[0]):064b}" for seed in (2, 3))
            for n, bit in enumerate(bits):
                votes[n] += (b - a) * (1 if bit == "1" else -1)
        assert got[k] == f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):032x}"


def test_search_by_permuted_blocks(spark):
    draw = random.Random(1)
    prints = [draw.getrandbits(128) for _ in range(40)]
    prints += [p ^ sum(1 << b for b in draw.sample(range(128), draw.randint(0, 6))) for p in prints * 3]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints] + [(None,)], "fingerprint string")
    for radius in (0, 2, 4):
        got = {(int(r.query, 16), int(r.fingerprint, 16)): r.distance for r in simhash.near(df, df, radius).collect()}
        assert got == {(a, b): (a ^ b).bit_count() for a in prints for b in prints if (a ^ b).bit_count() <= radius}


def test_search_finds_near_copies(spark):
    """All pairs and counts within the default radius, as by brute force, and most texts with some words replaced."""
    draw = random.Random(6)
    base = [[draw.choice(["alpha", "be", "gamma", "delta", "of", "zeta"]) + str(draw.randrange(400)) for _ in range(150)] for _ in range(40)]
    copies = [[w if draw.random() > 0.02 else "other" for w in b] for b in base]
    rows = [(k, " ".join(b)) for k, b in enumerate([*base, *copies, *base[:5]])]
    prints = simhash.fingerprint(table(spark, rows), {"text": "fingerprint"}).cache()
    ints = {r.doc_id: int(r.fingerprint, 16) for r in prints.collect()}
    want = {(a, b): (a ^ b).bit_count() for a in set(ints.values()) for b in set(ints.values()) if (a ^ b).bit_count() <= simhash.RADIUS}
    rows = simhash.near(prints, prints).collect()
    assert len(rows) == len(want) and {(int(r.query, 16), int(r.fingerprint, 16)): r.distance for r in rows} == want
    assert sum((ints[k], ints[40 + k]) in want for k in range(40)) >= 38
    got = {int(r.query, 16): r.n for r in simhash.near_counts(prints, prints).collect()}
    assert got == {a: sum((a ^ b).bit_count() <= simhash.RADIUS for b in ints.values()) for a in set(ints.values())}
    draw = random.Random(7)
    some = [draw.getrandbits(128) for _ in range(30)]
    some += [p ^ sum(1 << b for b in draw.sample(range(128), draw.randint(0, 34))) for p in some * 4]
    df = spark.createDataFrame([(f"{p:032x}",) for p in some] + [(None,)], "fingerprint string")
    for radius in (7, 22, 30):
        rows = simhash.near(df, df, radius).collect()
        want = {(a, b): (a ^ b).bit_count() for a in some for b in some if (a ^ b).bit_count() <= radius}
        assert len(rows) == len(want) and {(int(r.query, 16), int(r.fingerprint, 16)): r.distance for r in rows} == want


# --- op7, op9 --------------------------------------------------------------------------------------------------------


def library_ids(path, texts):
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    draw = random.Random(3)
    pieces = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "字", "，", " ", " ", "<|endoftext|>", "!", "\t", "\x1c", "½", "😀", "word"]
    out = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 300))) for _ in range(200)]
    out += ["".join(draw.choice("字词的，") for _ in range(draw.randint(0, 600))) for _ in range(60)]
    out += ["".join(draw.choice(" \n ") for _ in range(draw.randint(0, 300))) + "x" for _ in range(60)]
    return [*out, "", "a" * 3000, " " * 500, "<|endoftext|>" * 3]


def test_encoders_are_the_library(vocab_path):
    texts = odd_texts() + [x or "" for _, x in awkward()]
    want = library_ids(vocab_path, texts)
    vocab = bpe.vocabulary(vocab_path)
    for bits in (1, 4, 7):
        own = bpe.ChunkEncoder(vocab, mask_bits=bits)
        assert [own.encode(x.encode()) for x in texts] == want
        assert bits > 4 or (own.repaired and own.reused)
    assert [vocab.encode(x.encode()) for x in texts] == want
    assert [vocab.decode(np.frombuffer(x, "<u4")) for x in want] == texts


def test_unbroken_text_takes_linear_time(vocab_path):
    draw = random.Random(9)
    texts = ["".join(draw.choice("acgt") for _ in range(200_000)), "".join(draw.choice("acgt") for _ in range(40_000)) + " and words " * 50 + "x1" * 3000]
    own = bpe.ChunkEncoder(bpe.vocabulary(vocab_path))
    began = time.time()
    got = [own.encode(x.encode()) for x in texts]
    assert time.time() - began < 5
    assert got == library_ids(vocab_path, texts)


def test_other_vocabularies_are_refused(vocab_path, tmp_path):
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "other.json"))


def test_round_trip(spark, vocab_path):
    rows = awkward() + list(enumerate(odd_texts(), 1000)) + [(None, "x"), (0, "x")]
    df = table(spark, rows)
    ids = library_ids(vocab_path, [x or "" for _, x in rows])
    want = Counter((k, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for (k, x), i in zip(rows, ids))
    assert Counter(tuple(r) for r in bpe.round_trip(df, vocab_path).collect()) == want
    assert Counter((r.doc_id, r._text) for r in bpe.decode(bpe.encode(df, vocab_path), vocab_path).collect()) == Counter((k, x or "") for k, x in rows)
    assert bpe.round_trip(table(spark, []), vocab_path).count() == 0


def test_token_files(spark, vocab_path, tmp_path):
    rows = awkward(5) + [(None, "z"), (6, "again"), (6, "again")]
    path = str(tmp_path / "ids")
    token_files.write(table(spark, rows), path, vocab_path, partitions=3)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, Counter()
    for (k, _), ids in zip(order, library_ids(vocab_path, [x or "" for _, x in order])):
        ids += b"\0\0\0\0"
        want[k, at, len(ids) // 4, zlib.crc32(ids)] += 1
        at += len(ids) // 4
    assert Counter(tuple(r) for r in token_files.positions(spark, path).collect()) == want
    files = {}
    for r in token_files.read(spark, path).collect():
        assert len(r.ids) == r.n_tokens
        files.setdefault(r.part, []).append(r.doc_id or -1)
    bounds = [(min(v), max(v)) for _, v in sorted(files.items())]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    token_files.write(table(spark, []), str(tmp_path / "none"), vocab_path, partitions=2)
    assert token_files.positions(spark, str(tmp_path / "none")).count() == 0


# --- op8 -------------------------------------------------------------------------------------------------------------


def brute_removal(rows, length=50):
    first = {}
    for k, x in rows:
        w = words(x)
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, k), k)
    out = {}
    for k, x in rows:
        w = words(x)
        gone = {p for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < k for p in range(i, i + length)}
        out[k] = (len(w), len(gone), " ".join(v for p, v in enumerate(w) if p not in gone))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("length", [31, 50, 64])
def test_substrings(spark, length):
    rows = awkward(length, 70)
    want = brute_removal(rows, length)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(table(spark, rows), length).collect()}
    assert got == {k: (n, g, hashlib.sha256(t.encode()).hexdigest()) for k, (n, g, t) in want.items()}
    assert any(g for _, g, _ in want.values())
    made = substrings.deduplicated(table(spark, rows), length)
    assert made.columns == table(spark, rows).columns
    texts = dict(rows)
    assert {r.doc_id: r.text for r in made.collect()} == {k: (t if g else texts[k]) for k, (_, g, t) in want.items()}


def test_substrings_of_odd_tables(spark):
    assert substrings.digest(table(spark, [])).count() == 0
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(None, long), (None, long), (4, long), (4, long), (9, "a " + long), (10, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.digest(table(spark, rows)).collect())
    assert got == [(False, 4, 0), (False, 4, 0), (False, 9, 80), (False, 10, 0), (True, 0, 0), (True, 0, 0)]
    with pytest.raises(ValueError):
        substrings.digest(table(spark, rows), 20)


# --- op10 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shares", [[1, 1, 1, 1, 1, 5], [300, 7, 11, 682], [1] * 20 + [80], [1]])
def test_period_has_less_than_one_block_of_deviation(spark, shares):
    rows = sorted(mixing.period_table(spark, shares).collect(), key=lambda r: r.at)
    total, had = sum(shares), [0] * len(shares)
    assert [r.at for r in rows] == list(range(total))
    for r in rows:
        share = shares[r.source_no]
        assert r.turn == had[r.source_no]
        assert r.turn * total // share <= r.at < -(-(r.turn + 1) * total // share)  # release and deadline
        had[r.source_no] += 1
        assert all(abs(h - Fraction(s * (r.at + 1), total)) < 1 for h, s in zip(had, shares))
    assert had == shares


def test_mixing(spark):
    draw = random.Random(2)
    rows = [(k if k % 50 else None, draw.choice(["a", "a", "a", "b", None])) for k in range(500)] + [(3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit(None).cast("string")).withColumn("_row", F.lit(1))
    got = mixing.schedule(df, weights={"a": 0.25, "b": 0.5, None: 0.25}, block_docs=4, salts=5).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    sizes = Counter(r.source for r in got)
    weight = {"a": 2, "b": 4, None: 2}
    slots = sorted({(r.slot, r.source) for r in got}, key=lambda s: s[0])
    assert len({s for s, _ in slots}) == len(slots)
    had = Counter()
    for slot, source in slots:
        had[source] += 1
        for s, n in sizes.items():
            if had[s] < -(-n // 4):
                assert abs(had[s] - weight[s] * (slot + 1) / 8) < 1
    assert mixing.mixed(df).columns == df.columns and Counter((r.doc_id, r.source) for r in mixing.mixed(df).collect()) == Counter(rows)
    assert mixing.schedule(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(df, weights={"a": -1.0})


@pytest.mark.parametrize(
    "weights",
    [{"a": 0.9, "b": 0.1}, {"a": 0.95, "b": 0.05}, {"a": 1.0, "b": 0.0}, {"big": 500.0} | {f"s{k}": 1.0 for k in range(500)}],
    ids=["0.9", "0.95", "zero", "many"],
)
def test_mixing_keeps_to_the_given_weights(spark, weights):
    """Less than one block from the weights as given, long after any period; sources of weight 0 follow the others."""
    target = {s: Fraction(str(w)) / sum(Fraction(str(w)) for w in weights.values()) for s, w in weights.items()}
    n = {s: max(1, int(4000 * w)) if w else 30 for s, w in target.items()}
    df = spark.createDataFrame([(k, s) for s, m in n.items() for k in range(m)], "doc_id long, source string")
    got = sorted((r.slot, r.source) for r in mixing.schedule(df, weights=weights, block_docs=1).collect())
    assert len({t for t, _ in got}) == len(got) and Counter(s for _, s in got) == n
    worst = 0
    turns = {s: [t for t, x in got if x == s] for s in n}
    for s, at in turns.items():
        w = target[s]
        if w:
            worst = max(worst, max(max(abs(j + 1 - w * (t + 1)), abs(j - w * t)) for j, t in enumerate(at)))
        else:
            assert at[0] == 1 + max(t for x, ts in turns.items() if target[x] for t in ts)
    assert worst < 1


def test_mixing_of_many_sources(spark):
    """More sources than any period has slots, all by joined tables; also where no table is small enough to be broadcast."""
    n = {f"site{k}": 1 + 8 * (k % 5 == 0) for k in range(2500)} | {None: 900}
    df = spark.createDataFrame([(k, s) for s, m in n.items() for k in range(m)], "doc_id long, source string")
    for most in (1 << 20, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "BROADCAST_ROWS", most)
            m.setattr(mixing, "PIECE", 3000)
            got = sorted((r.slot, r.source or "", r.place) for r in mixing.schedule(df, block_docs=1).collect())
        assert len({t for t, _, _ in got}) == len(got) and Counter(s or None for _, s, _ in got) == n
        total, at = sum(x**0.5 for x in n.values()), {}
        for t, s, _ in got:
            at.setdefault(s or None, []).append(t)
        for s, turns in at.items():
            w = n[s] ** 0.5 / total
            assert all(abs(j + 1 - w * (t + 1)) < 1 and abs(j - w * t) < 1 for j, t in enumerate(turns))
