"""Language identification by interpolated Kneser-Ney character models, one per language.

A text's words are lower-cased and stripped to their letters; every letter and the end of each word is predicted from the
``ORDER - 1`` characters before it in the word. N-grams of all languages are stored by 64-bit hashes in sorted arrays, one
array per order, with a column per language, so one binary search serves all languages; a worker remembers the outcome for
each n-gram of ``ORDER`` characters, up to a bound, and looks up all predictions of many texts at once. The language with the
lowest cross-entropy per character is chosen. ``score`` is a logistic calibration of its lead over the second; ``rejected`` marks
texts whose cross-entropy is above what nearly all training texts of that language have, or whose score is below a half.

Counts cover every training row. Spark aggregates them and those of the lower orders; the driver takes them all, as hashes
and numbers and in pieces of about ``PIECE`` rows, makes the tables and broadcasts them. So the models grow with the
distinct n-grams of the training rows. The calibration, too, is of every training row: Spark counts their cross-entropies and
leads in steps of ``1 / STEPS``, which bounds what the driver gets, and a language with more rows than the mean weighs as the
mean. ``learn_and_identify`` scores each text once for both, the calibration and its prediction.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows every text is; null
ids count as held out and are not learned from; repeated rows are predicted each on its own (and count each as training);
an empty table gives an empty result; further columns are ignored unless asked for with ``keep``, where one named as an added column gives way. Very long texts are scored
whole, in pieces cut between words.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmatch.plans.storage import written

from .bpe import texts_of
from .kernel import SEPARATORS, U, carried, mix
from .linear import ridge, sigmoid

ORDER = 5
START, END = "\x02", "\x03"
#: Steps of a unit in which the calibration counts.
STEPS = 1024
#: Rows of the models' tables that the driver takes at once.
PIECE = 4_000_000
#: Bytes of texts, about, whose predictions are looked up at once.
PIECE_BYTES = 1 << 18


def held_out_row(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether the crc32 of the key, written as text, leaves ``remainder``; true for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def letters(raw: bytes) -> str:
    """A word's letters in lower case."""
    w = raw.decode("utf-8", "replace").lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


def count_grams(train: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all of ``train(lang, text)``: n-grams of ``ORDER`` characters of the padded words."""

    def run(batches):
        words: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def flush():
            out = []
            for lang, counts in words.items():
                plain: Counter = Counter()
                for raw, n in counts.items():
                    w = letters(raw)
                    if w:
                        plain[w] += n
                grams: Counter = Counter()
                for w, n in plain.items():
                    padded = START * (ORDER - 1) + w + END
                    for k in range(len(w) + 1):
                        grams[padded[k : k + ORDER]] += n
                out.append(pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())}))
            words.clear()
            return pa.RecordBatch.from_pandas(pd.concat(out), schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]), preserve_index=False)

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words[lang].update(raw.split())
            size = sum(map(len, words.values()))
            if size > 1_000_000:
                yield flush()
        if words:
            yield flush()

    counted = train.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _hash(codes: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` code points before each of ``ends``."""
    return _hash_of([codes[ends - k + j] for j in range(k)], len(ends))


def _hash_of(columns: list[np.ndarray], n: int) -> np.ndarray:
    """Hashes of ``n`` rows of code points, given by column."""
    h = np.full(n, len(columns), U)
    for c in columns:
        h += c
        h *= U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return mix(h)


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 for letters, 2 for what ends words, else 0."""
    out = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(SEPARATORS)] = 2
    return out


def windows(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The padded words of all texts as ``ORDER`` columns of code points, a row for each prediction; the rows of each text."""
    plain = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer("".join(f"{t}\n" for t in plain).encode("utf-32-le"), "<u4")
    kind = _kinds()[codes]
    at = np.flatnonzero(kind)
    last = kind[at] == 2
    first = np.concatenate([[True], last[:-1]])
    used = ~(first & last)  # words without a letter
    at, last, first = at[used], last[used], first[used]
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])[: len(at)])
    columns = [codes[at].astype(U)]
    columns[0][last] = ord(END)
    for _ in range(ORDER - 1):
        before = np.empty_like(columns[0])
        before[1:] = columns[0][:-1]
        before[first] = ord(START)
        columns.insert(0, before)
    ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in plain]))
    return columns, np.diff(ends, prepend=0)


class Numbers:
    """Numbers from 0 for 64-bit hashes, in the order in which they are added: open addressing in arrays."""

    def __init__(self):
        self.n = 0
        self._room(1 << 12)

    def _room(self, slots: int) -> None:
        # a number is stored plus one; 0 is an empty slot
        self.keys, self.held, self.last = np.zeros(slots, U), np.zeros(slots, np.int32), slots - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the hashes, -1 for those without."""
        at = (h & U(self.last)).astype(np.intp)
        out = self.held[at]
        other = np.flatnonzero((self.keys[at] != h) & (out > 0))
        while len(other):
            slot = (at[other] + 1) & self.last
            at[other], out[other] = slot, self.held[slot]
            other = other[(self.keys[slot] != h[other]) & (out[other] > 0)]
        return out - 1

    def add(self, h: np.ndarray) -> None:
        """Numbers hashes, of which none is repeated or has a number."""
        if 2 * (self.n + len(h)) > self.last:
            full = np.flatnonzero(self.held)
            keys, held = self.keys[full], self.held[full]
            self._room(1 << int(4 * (self.n + len(h))).bit_length())
            self._put(keys, held)
        self._put(h, np.arange(self.n + 1, self.n + 1 + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        at = (h & U(self.last)).astype(np.intp)
        while len(h):
            free = self.held[at] == 0
            self.held[at[free]], self.keys[at[free]] = number[free], h[free]
            lost = self.held[at] != number  # taken, or by another of these
            h, number, at = h[lost], number[lost], (at[lost] + 1) & self.last


def discounts(once, twice):
    """The absolute discount of an order, from its numbers of n-grams counted once and twice."""
    return np.clip(np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.1, 0.95)


def all_orders(grams: DataFrame) -> DataFrame:
    """``(k, lang, gram, n)``: the counts of the longest n-grams, and of each shorter one how many characters it follows."""
    ends = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("k"), F.substring("gram", ORDER - k + 1, k).alias("gram"), F.substring("gram", ORDER - k, 1).alias("_before"))
            for k in range(1, ORDER)
        ])
    )
    shorter = grams.select("lang", ends.alias("e")).select("e.k", "lang", "e.gram", "e._before").distinct()
    shorter = shorter.groupBy("k", "lang", "gram").agg(F.count("*").alias("n"))
    return grams.select(F.lit(ORDER).alias("k"), "lang", "gram", "n").unionByName(shorter)


def _hashed(rows: DataFrame) -> DataFrame:
    """``(k, lang, key, context, n)`` of ``(k, lang, gram, n)``: the hashes of the n-gram and of all but its last character."""

    def run(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            grams = np.array(batch.column(2).to_pylist(), dtype=object)
            keys, contexts = np.empty(len(k), U), np.empty(len(k), U)
            for own in np.unique(k).tolist():
                at = k == own
                keys[at], contexts[at] = Models._of(grams[at], own, own), Models._of(grams[at], own, own - 1)
            made = [pa.array(x.view(np.int64)) for x in (keys, contexts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, batch.column(3)], names=["k", "lang", "key", "context", "n"])

    return rows.select("k", "lang", "gram", "n").mapInArrow(run, "k int, lang string, key long, context long, n long")


def _weighed(lang: np.ndarray, n: np.ndarray, ctx: np.ndarray, discount: np.ndarray):
    """Each row's discounted share of its context, the contexts in order, and their back-off weights by language."""
    ckeys, crow = np.unique(ctx, return_inverse=True)
    total, kinds = np.zeros((len(ckeys), len(discount))), np.zeros((len(ckeys), len(discount)))
    np.add.at(total, (crow, lang), n)
    np.add.at(kinds, (crow, lang), 1)
    share = (np.maximum(n - discount[lang], 0) / total[crow, lang]).astype(np.float32)
    return share, ckeys, np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0).astype(np.float32)


def _by_key(hashes: np.ndarray, lang: np.ndarray, share: np.ndarray, n_lang: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes in order, and their shares by language."""
    keys, row = np.unique(hashes, return_inverse=True)
    values = np.zeros((len(keys), n_lang), np.float32)
    values[row, lang] = share
    return keys, values


class Models:
    """The tables of all languages: discounted shares of n-grams and back-off weights of contexts, by sorted hashes."""

    def __init__(self, grams: pd.DataFrame):
        self.langs = sorted(grams["lang"].unique())
        n_lang = len(self.langs)
        chars = set("".join(grams["gram"].unique()))
        self.uniform = 1.0 / (len(chars) + 1)
        self.grams, self.contexts = [], []
        tables = grams
        by_order = {}
        for k in range(ORDER, 0, -1):
            by_order[k] = tables
            shorter = pd.DataFrame({"lang": tables["lang"], "gram": tables["gram"].str[1:]})
            tables = shorter.groupby(["lang", "gram"], sort=False).size().rename("n").reset_index()
        for k in range(1, ORDER + 1):
            t = by_order[k]
            lang = pd.Categorical(t["lang"], categories=self.langs).codes.astype(np.int64)
            hashes = self._of(t["gram"], k, k)
            ctx = self._of(t["gram"], k, k - 1)
            n = t["n"].to_numpy(np.float64)
            discount = discounts(np.bincount(lang[n == 1], minlength=n_lang), np.bincount(lang[n == 2], minlength=n_lang))
            share, ckeys, back = _weighed(lang, n, ctx, discount)
            self.grams.append(_by_key(hashes, lang, share, n_lang))
            self.contexts.append((ckeys, back))

    @classmethod
    def learned(cls, grams: DataFrame) -> Models | None:
        """The same tables from all of Spark's ``grams(lang, gram, n)``; none if there are no rows."""
        rows = written(_hashed(all_orders(grams)), "orders")
        ones = {(r[0], r[1]): r[2:] for r in rows.groupBy("k", "lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count("*")).collect()}
        if not ones:
            return None
        out = cls.__new__(cls)
        out.langs, out.grams, out.contexts = sorted({lang for _, lang in ones}), [], []
        n_lang = len(out.langs)
        for k in range(1, ORDER + 1):
            own = [ones[k, lang] for lang in out.langs]
            discount = discounts(np.array([x[0] for x in own]), np.array([x[1] for x in own]))
            pieces = -(-sum(x[2] for x in own) // PIECE)
            made = []
            for piece in range(pieces):
                # ranges of the context's hash as an unsigned number: no context is in two, and they follow one another
                part = F.expr(f"(shiftrightunsigned(context, 32) * {pieces}) >> 32") == piece
                t = rows.where((F.col("k") == k) & part).select("key", "context", "n", "lang").toArrow()
                lang = pc.index_in(t["lang"], pa.array(out.langs)).to_numpy()
                hashes, ctx = (t[c].to_numpy().view(U) for c in ("key", "context"))
                share, ckeys, back = _weighed(lang, t["n"].to_numpy().astype(np.float64), ctx, discount)
                made.append((hashes, lang, share, ckeys, back))
            hashes, lang, share, ckeys, back = (np.concatenate(x) for x in zip(*made))
            out.grams.append(_by_key(hashes, lang, share, n_lang))
            out.contexts.append((ckeys, back))
        # every character ends some n-gram, but for START
        out.uniform = 1.0 / (len(out.grams[0][0]) + 2)
        return out

    @staticmethod
    def _of(grams: pd.Series, k: int, width: int) -> np.ndarray:
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(U)
        return _hash(codes, np.arange(len(grams)) * k + width, width)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word: its log-likelihood under every language, and its number of predictions."""
        joined = "".join(START * (ORDER - 1) + w + END for w in words)
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(U)
        ends = np.flatnonzero(codes != ord(START)) + 1
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        logs = self.logs([codes[ends - ORDER + j] for j in range(ORDER)])
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0), sizes

    def logs(self, columns: list[np.ndarray]) -> np.ndarray:
        """The log-likelihood under every language of the last of each row's ``ORDER`` characters after the others."""
        n = len(columns[0])
        p = np.full((n, len(self.langs)), self.uniform, np.float32)
        for k in range(1, ORDER + 1):
            context, gram = columns[ORDER - k : ORDER - 1], columns[ORDER - k :]
            for (keys, values), own, fill in ((self.contexts[k - 1], context, 1.0), (self.grams[k - 1], gram, 0.0)):
                h = _hash_of(own, n)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                rows = np.where((keys[place] == h)[:, None], values[place], np.float32(fill))
                p = p * rows if fill else p + rows
        return np.log(p).astype(np.float64)


_SPACE = re.compile(b"[" + bytes(SEPARATORS) + b"]")


def _pieces(raw: bytes):
    """A text, cut between words if it is long."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        space = _SPACE.search(raw, start + PIECE_BYTES)
        if space is None:
            break
        yield raw[start : space.start()]
        start = space.end()
    yield raw[start:]


class Scorer:
    """Cross-entropies of texts under every language; n-grams are looked up once while they are remembered."""

    #: Bytes of the log-likelihoods that are remembered, about.
    LIMIT = 1 << 25

    def __init__(self, models: Models):
        self.models = models
        self._clear()

    def _clear(self):
        self.numbers, self.logs = Numbers(), np.empty((len(self.models.langs), 1 << 12))

    def _numbered(self, columns: list[np.ndarray]) -> np.ndarray:
        """The number of each row's n-gram among the remembered ones, with the new ones."""
        if self.logs.nbytes > self.LIMIT and 2 * self.numbers.n > self.logs.shape[1]:
            self._clear()
        h = _hash_of(columns, len(columns[0]))
        out = self.numbers.find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            keys, row = np.unique(h[missing], return_index=True)
            known = self.numbers.n
            need = known + len(keys)
            self.numbers.add(keys)
            if need > self.logs.shape[1]:
                grown = np.empty((len(self.logs), 1 << need.bit_length()))
                grown[:, :known] = self.logs[:, :known]
                self.logs = grown
            self.logs[:, known:need] = self.models.logs([c[missing[row]] for c in columns]).T
            out[missing] = self.numbers.find(h[missing])
        return out

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``[texts, languages]`` of log-likelihoods, and the number of predictions of each text."""
        columns, n = windows(texts)
        out = np.zeros((len(texts), len(self.models.langs)))
        full = np.flatnonzero(n)
        if len(full):
            number, first = self._numbered(columns), (np.cumsum(n) - n)[full]
            for k, logs in enumerate(self.logs):
                out[full, k] = np.add.reduceat(logs[number], first)
        return out, n

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``[texts, languages]`` of cross-entropy per prediction, and the number of predictions of each text."""
        out, n = np.zeros((len(texts), len(self.models.langs))), np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0

        def flush():
            sums, counts = self.sums(parts)
            np.add.at(out, owners, sums)
            np.add.at(n, owners, counts)

        for k, raw in enumerate(texts):
            for piece in _pieces(raw):
                if parts and size + len(piece) > PIECE_BYTES:
                    flush()
                    parts, owners, size = [], [], 0
                parts.append(piece)
                owners.append(k)
                size += len(piece)
        if parts:
            flush()
        return -out / np.maximum(n, 1)[:, None], n


class Identifier:
    """Models with their calibration."""

    def __init__(self, models: Models | None):
        self.models, self.weights, self.limits = models, np.array([0.0, 1.0]), None

    def features(self, entropy: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(best)), best]
        if entropy.shape[1] > 1:
            lead = np.partition(entropy, 1, axis=1)[:, 1] - lowest
        else:
            lead = np.ones(len(best))
        return best, lowest, lead * np.sqrt(n)

    def calibrate(self, measures: DataFrame) -> None:
        """Fits the score and the limits of rejection to all rows of ``measures(lang, best, lowest, lead, n)`` with letters."""
        langs = self.models.langs
        rows = measures.where("n > 0 and lang is not null")
        step = lambda x: F.floor(x * STEPS).alias("at")
        leads = rows.groupBy("lang", (F.col("lang") == F.array(*map(F.lit, langs))[F.col("best")]).alias("right"), step(F.log1p("lead"))).count().toPandas()
        leads = leads.sort_values(["lang", "right", "at"])  # the same sums in every run
        if not len(leads):
            return
        each = leads.groupby("lang")["count"].sum()
        weight = leads["count"] * np.minimum(1.0, each.mean() / each)[leads["lang"]].to_numpy()
        self.weights = ridge((leads["at"].to_numpy()[:, None] + 0.5) / STEPS, leads["right"].to_numpy(float), counts=weight.to_numpy())
        self.limits = np.full(len(langs), np.inf)
        lowest = rows.groupBy("best", step(F.col("lowest"))).count().toPandas().sort_values("at")
        for best, own in lowest.groupby("best"):
            passed = own["count"].cumsum().to_numpy()
            self.limits[best] = (own["at"].to_numpy()[np.searchsorted(passed, 0.995 * passed[-1])] + 1) / STEPS

    def predict(self, best: np.ndarray, lowest: np.ndarray, lead: np.ndarray, n: np.ndarray):
        score = sigmoid(self.weights[0] + self.weights[1] * np.log1p(lead))
        rejected = score < 0.5
        if self.limits is not None:
            rejected |= lowest > 1.1 * self.limits[best]
        return best, np.where(n > 0, score, 0.0), rejected | (n == 0)


def _trained(docs: DataFrame) -> DataFrame:
    return docs.select("lang", "text").where("lang is not null and text is not null")


def fit(train: DataFrame) -> Identifier:
    """The identifier learned from ``train(lang, text)``; rows with a null in either are left out."""
    rows = _trained(train)
    out = Identifier(Models.learned(written(count_grams(rows), "grams")))
    if out.models is not None:
        out.calibrate(written(measured(rows, out, ("lang",)), "measures"))
    return out


def learn_and_identify(docs: DataFrame, training: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What ``identify`` returns for ``docs(lang, text)`` with the model that ``fit`` learns from its ``training`` rows."""
    out = Identifier(Models.learned(written(count_grams(_trained(docs.where(training))), "grams")))
    keep = carried(keep, ADDED)
    if out.models is None:
        return identify(docs, out, keep)
    own_keep = tuple(f"_kept{k}" for k in range(len(keep)))  # as in identify
    own = docs.select(*[F.col(c).alias(x) for c, x in zip(keep, own_keep)], F.when(training, F.col("lang")).alias("_lang"), "text")
    made = written(measured(own, out, (*own_keep, "_lang")), "measures")
    out.calibrate(made.select(F.col("_lang").alias("lang"), *MEASURES))
    return _predicted(made, out, own_keep).toDF(*keep, *ADDED)


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    """One scorer for each broadcast model and process; only the latest is kept."""
    if shared.id not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[shared.id] = Scorer(shared.value.models)
    return _SCORERS[shared.id]


class _Shared:
    """A broadcast with a name, by which workers know it again."""

    def __init__(self, spark, value):
        import uuid

        self.id, self.held = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self.held.value


def _scored(shared, column: pa.Array):
    texts = []
    size = 0
    for raw in texts_of(column):
        texts.append(raw)
        size += len(raw)
        if size > 1 << 20:
            yield _scorer(shared).batch(texts)
            texts, size = [], 0
    if texts:
        yield _scorer(shared).batch(texts)


ADDED = ("lang_pred", "score", "rejected")
MEASURES = ("best", "lowest", "lead", "n")


def measured(docs: DataFrame, model: Identifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and of each text: ``best``, the place of its language; its cross-entropy ``lowest``; its ``lead`` over the
    second's, and ``n``, the number of predictions."""
    shared = _Shared(docs.sparkSession, model)
    schema = docs.select(*keep).schema.add("best", "integer").add("lowest", "double").add("lead", "double").add("n", "long")

    def run(batches):
        own = shared.value
        for batch in batches:
            made = list(_scored(shared, batch.column(len(keep))))
            if made:
                e, n = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
                best, lowest, lead = own.features(e, n)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(best, pa.int32()), *map(pa.array, (lowest, lead, n))], names=schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def _predicted(measures: DataFrame, model: Identifier, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``rejected`` from ``keep`` and the columns that ``measured`` adds."""
    schema = measures.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names = np.array([*model.models.langs, "und"], dtype=object)
    small = Identifier(None)
    small.weights, small.limits = model.weights, model.limits

    def run(batches):
        for batch in batches:
            n = batch.column(len(keep) + 3).to_numpy()
            best, score, rejected = small.predict(*(batch.column(len(keep) + k).to_numpy() for k in range(3)), n)
            lang = names[np.where(n > 0, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return measures.select(*keep, *MEASURES).mapInArrow(run, schema)


def identify(docs: DataFrame, model: Identifier, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score`` and ``rejected`` for every text."""
    keep = carried(keep, ADDED)
    if model.models is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    own = [f"_kept{k}" for k in range(len(keep))]  # a kept column may have the name of a measure
    made = measured(docs.select(*[F.col(c).alias(x) for c, x in zip(keep, own)], text), model, tuple(own), text)
    return _predicted(made, model, tuple(own)).toDF(*keep, *ADDED)
