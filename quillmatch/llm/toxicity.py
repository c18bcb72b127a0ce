"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the hits' contexts.

The lexicon is learned from labelled rows: words, and beginnings of words, that toxic texts have far more often than
others. The trie of its terms and the automaton of one edit run together as one lazily built deterministic automaton: a
state is the set of (trie node, edits so far) that a word's letters can have led to. Whole words of five letters or more
also match with one letter changed, added or left out; beginnings match exactly.

Each hit has the log ratio of its term's rates in toxic and other texts. Of a text, the sums of exact, of misspelt and of
quoted hits, their sum per word and the densest window of ``CONTEXT`` words enter a logistic model, which also learns how
far a quotation excuses: a hit between quotation marks, or close behind a word of saying, counts as quoted.

Lexicon and model are fitted on at most about ``SAMPLE`` labelled rows; every term of theirs that passes the test is in the
lexicon, whatever their number.

Defined results: null and empty texts are scored as texts without hits; null ids count as held out; rows without a label
are scored but not learned from; repeated rows are scored each on its own; without labelled rows of both kinds there is no
lexicon and the score is the share of ones, 0.0 if there are none; an empty table gives an empty result; further columns
are left out unless asked for with ``keep``, where one named as an added column gives way to it. Very long texts are scored whole: a worker holds the words of one.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.storage import Scratch

from .bpe import texts_of
from .kernel import carried
from .language_id import _Shared, held_out_row
from .linear import ridge, sigmoid
from .quality_model import SAMPLE, labelled

CONTEXT = 20
FUZZY_LETTERS = 5
#: States after which the automaton is built anew, so that a worker's memory is bounded.
STATES = 100_000
_OPEN, _CLOSE = "\"'“„«‹‘", "\"'”“»›’"
#: Words of saying, in four languages.
SAYING = frozenset("said says wrote quoted called quote dit écrit sagte schrieb dijo escribió".split())


def plain_word(raw: bytes) -> str:
    """A word in lower case, without signs at its ends."""
    w = raw.decode("utf-8", "replace").lower()
    if w.isalnum():
        return w
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


class Lexicon:
    """Terms with weights; those that end in ``*`` are beginnings of words."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.start: list[float] = [0.0]
        for term, weight in terms.items():
            node = 0
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.start.append(0.0)
                node = self.children[node][c]
            if term.endswith("*"):
                self.start[node] = max(self.start[node], weight)
            else:
                self.word[node] = term
        self._begin()

    def _begin(self) -> None:
        """The automaton with its first state only."""
        self.states: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, float]] = []
        self.through: list[float] = []
        self._number(self._closed({0}))

    def _closed(self, items: set[int]) -> bytes:
        """With the letters that a word may have left out. An item is twice a node, and one more after an edit; a state is
        kept as its items in order, four bytes each."""
        out = set(items)
        for item in items:
            if not item & 1:
                out.update(2 * child + 1 for child in self.children[item >> 1].values())
        return array("i", sorted(out)).tobytes()

    def _number(self, state: bytes) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            exact = fuzzy = through = 0.0
            for item in array("i", state):
                node = item >> 1
                term = self.word[node]
                if not item & 1:
                    through = max(through, self.start[node])
                    if term is not None:
                        exact = max(exact, self.terms[term])
                elif term is not None and len(term) >= FUZZY_LETTERS:
                    fuzzy = max(fuzzy, self.terms[term])
            self.ends.append((exact, fuzzy))
            self.through.append(through)
        return n

    def _step(self, n: int, c: str) -> int:
        out = set()
        for item in array("i", self.states[n]):
            node, edits = item >> 1, item & 1
            child = self.children[node].get(c)
            if child is not None:
                out.add(2 * child + edits)
            if not edits:
                out.add(2 * node + 1)  # a letter too many
                out.update(2 * other + 1 for letter, other in self.children[node].items() if letter != c)
        to = self.steps[n][c] = self._number(self._closed(out))
        return to

    def match(self, word: str) -> tuple[float, float]:
        """The weight of an exact hit, by a whole word or a beginning, and that of a misspelt one; 0 for none."""
        if len(self.states) > STATES:
            self._begin()
        n, through = 0, 0.0
        for c in word:
            n = self.steps[n].get(c) if c in self.steps[n] else self._step(n, c)
            if self.through[n] > through:
                through = self.through[n]
            if not self.states[n]:
                return through, 0.0
        exact, fuzzy = self.ends[n]
        exact = max(exact, through)
        return exact, 0.0 if exact else fuzzy


class Scorer:
    LIMIT = 250_000

    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights
        self.seen: set[bytes] = set()
        self.hot: dict[bytes, tuple[float, float]] = {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
            self.hot.clear()
        new = set(words)
        new -= self.seen
        for raw in new:
            hit = self.lexicon.match(plain_word(raw))
            if hit[0] or hit[1]:
                self.hot[raw] = hit
        self.seen |= new

    def features(self, raw: bytes) -> list[float]:
        words = raw.split()
        self._learn(words)
        hot = self.hot
        at = [k for k, w in enumerate(words) if w in hot] if hot else []
        if not at:
            return [0.0] * 6
        exact = fuzzy = quoted = 0.0
        for k in at:
            e, f = hot[words[k]]
            if self._quoted(words, k):
                quoted += e + f
            else:
                exact += e
                fuzzy += f
        value = [sum(hot[words[k]]) for k in at]
        densest, a, inside = 0.0, 0, 0.0
        for b, k in enumerate(at):
            inside += value[b]
            while at[a] <= k - CONTEXT:
                inside -= value[a]
                a += 1
            densest = max(densest, inside)
        total = sum(value)
        return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(100 * total / len(words))), float(np.log1p(densest)), float(np.log1p(max(value)))]

    @staticmethod
    def _quoted(words: list[bytes], k: int) -> bool:
        w = words[k].decode("utf-8", "replace")
        if w[0] in _OPEN and w.rstrip(".,;:!?")[-1:] in _CLOSE:
            return True
        before = [x.decode("utf-8", "replace") for x in words[max(0, k - 6) : k]]
        if any(plain_word(x.encode()) in SAYING for x in before[-3:]):
            return True
        opened = any(x[0] in _OPEN and x.rstrip(".,;:!?")[-1:] not in _CLOSE for x in [*before, w])
        behind = [x.decode("utf-8", "replace") for x in words[k : k + 6]]
        return opened and any(x.rstrip(".,;:!?")[-1:] in _CLOSE for x in behind)


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The lexicon of ``rows(doc_id, text, y)``: terms whose share of toxic texts stands out by five deviations."""

    def run(batches):
        counts: list[Counter] = [Counter() for _ in range(4)]  # texts and places, of others and of toxic texts
        total = np.zeros(4)
        for batch in batches:
            for raw, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                words = Counter()
                for w, n in Counter(raw.split()).items():
                    words[plain_word(w)] += n
                words.pop("", None)
                found = Counter(words)
                for w, n in words.items():
                    for k in range(4, min(len(w), 9)):
                        found[w[:k] + "*"] += n
                counts[y].update(found.keys())
                counts[2 + y].update(found)
                total[y] += 1
                total[2 + y] += sum(words.values())
        names = [""] + [t for t in counts[1]] + [t for t in counts[0] if t not in counts[1]]
        data = [[int(total[k])] + [counts[k][t] for t in names[1:]] for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(d, pa.int64()) for d in data]], names=["term", "n0", "n1", "p0", "p1"])

    summed = rows.select("text", "y").mapInArrow(run, "term string, n0 long, n1 long, p0 long, p1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "p0", "p1")])
    with Scratch(rows.sparkSession) as tmp:
        # Toxic texts of one kind may be few, so a term has to be in five of them.
        counted = tmp.written(summed.where("n1 >= 5 or term = ''"), "terms")
        whole = counted.where("term = ''").first()
        if whole is None or not whole["n1"] or not whole["n0"]:
            return Lexicon({})
        n0, n1, p0, p1 = (float(whole[c]) for c in ("n0", "n1", "p0", "p1"))
        tested = counted.where("term <> ''").withColumn("_share", F.expr(f"(n0 + n1) / {n0 + n1!r}D"))
        tested = tested.withColumn("z", F.expr(f"(n1 / {n1!r}D - n0 / {n0!r}D) / sqrt(_share * (1 - _share) * {1 / n0 + 1 / n1!r}D)"))
        tested = tested.withColumn("weight", F.expr(f"ln((p1 + 0.5D) / {p1!r}D) - ln((p0 + 0.5D) / {p0!r}D)"))
        # What passes is of the sample's bound.
        found = tested.where("_share < 1 and z > 5 and weight > 1").select("term", "p1", "z", "weight").toPandas()
    # A beginning that one word makes up for the most part says nothing beyond that word.
    words = {t: n for t, n in zip(found["term"], found["p1"]) if not t.endswith("*")}
    most: dict[str, int] = {}
    for w, n in words.items():
        for k in range(4, min(len(w), 9)):
            most[w[:k]] = max(most.get(w[:k], 0), n)
    own = np.array([not t.endswith("*") or most.get(t[:-1], 0) < 0.6 * n for t, n in zip(found["term"], found["p1"])], bool)
    found = found[own].sort_values(["z", "term"], ascending=[False, True])
    return Lexicon(dict(zip(found["term"], found["weight"].astype(float))))


def _over(docs: DataFrame, shared, keep: tuple[str, ...], schema, finish) -> DataFrame:
    def run(batches):
        own = shared.value
        for batch in batches:
            x = np.array([own.features(raw) for raw in texts_of(batch.column(len(keep)))]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *finish(own, x)], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Scorer:
    """The scorer learned from ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``."""
    rows = labelled(docs, labels, label, sample)
    lexicon = learn_lexicon(rows)
    schema = rows.select("doc_id", "y").schema
    for k in range(6):
        schema = schema.add(f"x{k}", "double")
    shared = _Shared(docs.sparkSession, Scorer(lexicon))
    table = _over(rows, shared, ("doc_id", "y"), schema, lambda own, x: [pa.array(x[:, k]) for k in range(6)]).toPandas()
    y = table["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return Scorer(Lexicon({}), np.array([np.log(share / (1 - share)), *[0.0] * 6]))
    table = table.sort_values(list(table.columns))
    return Scorer(lexicon, ridge(table[[f"x{k}" for k in range(6)]].to_numpy(), table["y"].to_numpy(float)))


def score(docs: DataFrame, model: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``held_out``, ``score`` and ``predicted`` for every text of ``docs(doc_id, text)``."""
    keep = carried(keep, ("held_out", "score", "predicted"))
    inner = tuple(dict.fromkeys((*keep, "doc_id")))
    shared = _Shared(docs.sparkSession, Scorer(model.lexicon, model.weights))
    schema = docs.select(*inner).schema.add("score", "double")
    scored = _over(docs, shared, inner, schema, lambda own, x: [pa.array(sigmoid(own.weights[0] + x @ own.weights[1:]))])
    return scored.select(*keep, held_out_row(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
