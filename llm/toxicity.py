"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows around the hits.

Learning, on a bounded sample of labelled rows: words that toxic texts use and
others do not become the lexicon. The lexicon is a trie; the automaton of all
words within one or two edits of its terms is the trie walked with an edit
count, made deterministic state by state as texts need it. A term weighs what it
leans to toxic texts. A word some edits away from it inherits that weight, less a
penalty for each edit and less the more different words of clean texts stand as
near; so a misspelling counts that no labelled text holds. A near word that clean
texts do use ("oron" for a term one letter longer) weighs no more than it leans
itself. Terms of up to four letters are met by themselves only: at one edit most
words that short meet another word.

Scoring: every hit is looked at in its window. A hit between quotation marks is
counted apart from a direct one, and direct hits that stand together add to
each other. A logistic function of these sums is the score.

Nulls and odd rows: null and empty texts have no hits and score like any text
without hits; repeated rows score alike; a doc_id that is null or has no label
is scored but not learnt from; with no labels of a class the score is 0.5 times
the share of the other; an empty table gives an empty result. Texts beyond
``TEXT_AT_ONCE`` characters are read in parts; windows end at the parts' ends.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import stage

#: Labelled rows of each class that are learnt from, at most.
SAMPLE_ROWS = 8000
TERMS = 2000
#: Longer words are no terms.
TERM_CHARACTERS = 40
#: A term leans this far to toxic texts, and so often that few of all words are expected to do so by chance.
TERM_LEAN = 2.0
CHANCE_MARGIN = -2.0
#: Edits allowed for terms of at least so many characters.
EDITS = ((9, 2), (5, 1), (0, 0))
WEIGHT_FLOOR = 1.0
#: What an edit takes from the weight of a term.
EDIT_PENALTY = 1.0
#: Words on either side of a hit, and characters between quotation marks.
WINDOW = 12
QUOTE_SPAN = 240
TEXT_AT_ONCE = 1 << 20
FEATURES = 5
#: Keys that a worker counts before it passes them on.
KEYS_AT_ONCE = 1 << 16
#: A score from which a text counts as toxic.
THRESHOLD = 0.7

DEAD, UNKNOWN = 0, -1
_LETTERS = sys.maxunicode


def edits_allowed(term: str) -> int:
    return next(k for length, k in EDITS if len(term) >= length)


class TermAutomaton:
    """Trie of terms walked with edit counts; state 0 is dead, state 1 the start."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        alphabet = sorted({c for t in terms for c in t})
        # A class for every character of the terms; all others are in class 0, which always costs an edit.
        self.classes = np.zeros(_LETTERS + 1, dtype=np.int32)
        for i, c in enumerate(alphabet):
            self.classes[ord(c)] = i + 1
        self.children: list[dict[int, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.most: list[int] = [0]
        for number, term in enumerate(terms):
            node, k = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], k)
            for c in term:
                step = int(self.classes[ord(c)])
                if step not in self.children[node]:
                    self.children[node][step] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.most.append(0)
                node = self.children[node][step]
                self.most[node] = max(self.most[node], k)
            self.term_at[node] = number
        self.longest = max(map(len, terms), default=0) + self.most[0]
        self.width = len(alphabet) + 1
        self.table = np.full((1024, self.width), UNKNOWN, dtype=np.int32)
        self.accept = np.full(1024, -1, dtype=np.int64)
        self.cost = np.zeros(1024, dtype=np.int64)
        self.sets: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self._state({})
        self._state(self._skip({0: 0}) if terms else {})

    def _skip(self, at: dict[int, int]) -> dict[int, int]:
        """Term characters left out of the word."""
        queue = list(at.items())
        while queue:
            node, cost = queue.pop()
            for child in self.children[node].values():
                if cost + 1 <= self.most[child] and cost + 1 < at.get(child, 9):
                    at[child] = cost + 1
                    queue.append((child, cost + 1))
        return at

    def _state(self, at: dict[int, int]) -> int:
        key = tuple(sorted(at.items()))
        if key not in self.numbers:
            number = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            if number == len(self.table):
                self.table = np.vstack([self.table, np.full_like(self.table, UNKNOWN)])
                self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
                self.cost = np.concatenate([self.cost, np.zeros_like(self.cost)])
            hits = [(cost, self.term_at[n]) for n, cost in at.items() if self.term_at[n] >= 0]
            hits = [(cost, t) for cost, t in hits if cost <= edits_allowed(self.terms[t])]
            if hits:
                self.cost[number], self.accept[number] = min(hits)
            if not at:
                self.table[number] = number
        return self.numbers[key]

    def _step(self, state: int, symbol: int) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.most[node] and cost < reached.get(node, 9):
                reached[node] = cost

        for node, cost in self.sets[state]:
            reach(node, cost + 1)
            for step, child in self.children[node].items():
                reach(child, cost + (step != symbol or symbol == 0))
        return self._state(self._skip(reached))

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1: none) and edits of every word."""
        states = np.ones(len(starts), dtype=np.int64)
        states[(lengths > self.longest) | (lengths == 0)] = DEAD
        live = np.flatnonzero(states)
        for t in range(self.longest):
            live = live[(lengths[live] > t) & (states[live] != DEAD)]
            if not len(live):
                break
            now, symbol = states[live], symbols[starts[live] + t]
            after = self.table[now, symbol]
            if (unknown := after == UNKNOWN).any():
                for key in np.unique(now[unknown] * self.width + symbol[unknown].astype(np.int64)).tolist():
                    target = self._step(key // self.width, key % self.width)
                    self.table[key // self.width, key % self.width] = target
                after = self.table[now, symbol]
            states[live] = after
        return self.accept[states], self.cost[states]


_QUOTES = np.array([ord(c) for c in "\"“”„«»‹›"])
_SPACE = np.array([chr(c).isspace() for c in range(_LETTERS + 1)])
# Signs that are written on a letter belong to it.
_ALNUM = np.array([chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(_LETTERS + 1)])


class Words:
    """Words of a text: runs between white space without marks at their ends."""

    def __init__(self, text: str):
        self.lowered = text.lower()
        self.points = np.frombuffer(self.lowered.encode("utf-32-le"), dtype=np.uint32)
        edges = np.diff(np.concatenate([[True], _SPACE[self.points], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        alnum = np.append(_ALNUM[self.points], True)
        while (odd := (start < end) & ~alnum[start]).any():
            start = start + odd
        while (odd := (start < end) & ~alnum[end - 1]).any():
            end = end - odd
        keep = start < end
        self.starts, self.ends = start[keep], end[keep]

    def quoted(self, places: np.ndarray) -> np.ndarray:
        """Words at ``places`` that stand between an opening and a closing mark not far apart."""
        marks = np.flatnonzero(np.isin(self.points, _QUOTES))
        if not len(marks) or not len(places):
            return np.zeros(len(places), dtype=bool)
        opens = (marks == 0) | _SPACE[self.points[np.maximum(marks - 1, 0)]]
        right = np.searchsorted(marks, self.starts[places])
        has = (right > 0) & (right < len(marks))
        left = np.maximum(right - 1, 0)
        right = np.minimum(right, len(marks) - 1)
        return has & opens[left] & (marks[right] - marks[left] <= QUOTE_SPAN)


def parts_of(text: str | None) -> Iterator[str]:
    """The text, or parts that end at white space if it is long."""
    text, start = text or "", 0
    while len(text) - start > TEXT_AT_ONCE:
        end = next((i for i in range(start + TEXT_AT_ONCE, len(text)) if text[i].isspace()), len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def hits_of(automaton: TermAutomaton, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    terms, edits = automaton.run(automaton.classes[words.points], words.starts, words.ends - words.starts)
    places = np.flatnonzero(terms >= 0)
    return places, terms[places], edits[places]


def features(automaton: TermAutomaton, weights: np.ndarray, text: str | None, forms: dict[str, float] | None = None) -> list[float]:
    """Log sums of direct and quoted hits, different direct terms, best window, and density; ``forms`` have weights of their own."""
    direct = quoted = best = 0.0
    different: set[int] = set()
    count = 0
    for part in parts_of(text):
        words = Words(part)
        count += len(words.starts)
        places, terms, edits = hits_of(automaton, words)
        weight = weights[terms, edits]
        for i in np.flatnonzero(edits).tolist() if forms else ():
            form = words.lowered[words.starts[places[i]] : words.ends[places[i]]]
            weight[i] = forms.get(form, weight[i])
        heavy = weight >= WEIGHT_FLOOR
        places, terms, weight = places[heavy], terms[heavy], weight[heavy]
        if not len(places):
            continue
        cited = words.quoted(places)
        quoted += weight[cited].sum()
        places, terms, weight = places[~cited], terms[~cited], weight[~cited]
        if not len(places):
            continue
        direct += weight.sum()
        different.update(terms.tolist())
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        low, high = np.searchsorted(places, places - WINDOW), np.searchsorted(places, places + WINDOW, side="right")
        best = max(best, float((sums[high] - sums[low]).max()))
    return [np.log1p(direct), np.log1p(quoted), np.log1p(len(different)), np.log1p(best), np.log1p(100.0 * direct / (count + 20))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights and intercept (last) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """Texts with their label: of each class at most ``rows`` labelled rows that ``learn`` allows, by hash of the id."""
    marked = labels.where(learn & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
    by_hash = F.xxhash64("doc_id")
    chosen = [marked.where(F.col("y") == y).orderBy(by_hash, "doc_id").limit(rows) for y in (0, 1)]
    # Bounded: twice ``rows`` pairs of an id and a label.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).groupBy("doc_id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(ids, "doc_id")


def _counted(sample: DataFrame, keys_of: Iterable, spec: str, fields: list[str]) -> DataFrame:
    """Texts of each class in which a key stands, counted by batch and then summed."""

    kind = pa.string() if "string" in spec else pa.int64()

    def rows(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(counts[0].keys() | counts[1].keys())
        arrays = [pa.array([key[i] for key in keys], kind) for i in range(len(fields))]
        arrays += [pa.array([counts[y][key] for key in keys], pa.int64()) for y in (0, 1)]
        return pa.RecordBatch.from_arrays(arrays, [*fields, "clean", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1)):
                counts[y.as_py()].update(keys_of(text.as_py()))
                if len(counts[0]) + len(counts[1]) > KEYS_AT_ONCE:
                    yield rows(counts)
                    counts = (Counter(), Counter())
            yield rows(counts)

    return sample.select("text", "y").mapInArrow(run, f"{spec}, clean long, toxic long").groupBy(*fields).agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )


def _words_in(text: str | None) -> set[tuple[str]]:
    found = set()
    for part in parts_of(text):
        words = Words(part)
        spans = zip(words.starts.tolist(), words.ends.tolist())
        found.update((words.lowered[a:b],) for a, b in spans if b - a <= TERM_CHARACTERS + EDITS[0][1])
    return found


def _lean(toxic, clean, n_toxic: int, n_clean: int):
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


class Model:
    """Terms, weights by (term, edits) and of single near words, and the logistic function of the features."""

    def __init__(self, terms: list[str], weights: np.ndarray, beta: np.ndarray, forms: dict[str, float] | None = None):
        self.terms, self.weights, self.beta, self.forms = terms, weights, beta, forms or {}

    def scorer(self):
        automaton = TermAutomaton(self.terms)

        def score(text: str | None) -> float:
            z = float(np.dot(features(automaton, self.weights, text, self.forms), self.beta[:-1]) + self.beta[-1])
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = stage(labelled_sample(docs, labels, "toxic", learn, sample_rows), "toxic-sample")
    sizes = dict(sample.groupBy("y").count().collect())
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        share = 0.5 * n_toxic / max(1, n_clean + n_toxic)
        return Model([], np.zeros((0, 3)), np.array([0.0] * FEATURES + [np.log(share / (1 - share)) if share else -30.0]))
    counted = stage(_counted(sample, _words_in, "word string", ["word"]), "toxic-words")
    n_words = counted.count()
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    lean = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    # Log of the chance that texts hold a word without regard to their class fall like this.
    unlikely = toxic * F.log(toxic / ((toxic + clean) * share)) + F.when(
        clean > 0, clean * F.log(clean / ((toxic + clean) * (1 - share)))
    ).otherwise(0.0)
    terms = (
        counted.where((F.length("word") <= TERM_CHARACTERS) & (F.col("toxic") > 0) & (lean >= TERM_LEAN) & (unlikely >= np.log(max(1, n_words)) + CHANCE_MARGIN))
        .orderBy(unlikely.desc(), "word").limit(TERMS).select("word")
    )
    terms = sorted(row.word for row in terms.collect())

    kept = sample.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(kept.value)
        for batch in batches:
            words = Words(" ".join(batch.column(0).to_pylist()))
            places, hit, edits = hits_of(automaton, words)
            chosen = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays(
                [*chosen.columns, pa.array(hit, pa.int64()), pa.array(edits, pa.int64())], ["word", "clean", "toxic", "term", "edits"]
            )

    found = counted.select("word", "clean", "toxic").mapInArrow(near, "word string, clean long, toxic long, term long, edits long")
    weights = np.zeros((len(terms), 3))
    forms: dict[str, float] = {}
    # Bounded: the terms, and words of the sample's clean texts within two edits of a term.
    hits = found.where((F.col("edits") == 0) | (F.col("clean") > 0)).collect()
    for row in hits:
        if not row.edits:
            weights[row.term] += _lean(row.toxic, row.clean, n_toxic, n_clean) - EDIT_PENALTY * np.arange(3)
    used = Counter((row.term, row.edits) for row in hits if row.edits)
    for (term, edits), different in used.items():
        weights[term, edits] -= np.log1p(different)
    weights = np.minimum.accumulate(weights, axis=1)
    for row in hits:
        own = _lean(row.toxic, row.clean, n_toxic, n_clean)
        if row.edits and own < weights[row.term, row.edits]:
            forms[row.word] = float(own)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(kept.value)
        for batch in batches:
            rows = [features(automaton, weights, t.as_py(), forms) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    measured = sample.select("text", "y").mapInArrow(measure, "y int, x array<double>").collect()
    x, y = np.array([r.x for r in measured]), np.array([r.y for r in measured], dtype=float)
    order = np.lexsort([*x.T, y])
    return Model(terms, weights, fit_logistic(x[order], y[order]), forms)


_automata: dict[tuple, TermAutomaton] = {}


def _automaton(terms: list[str]) -> TermAutomaton:
    """One per worker, so that states made for one batch serve the next."""
    key = tuple(terms)
    if key not in _automata:
        _automata.clear()
        _automata[key] = TermAutomaton(terms)
    return _automata[key]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kept.value.scorer()
        for batch in batches:
            values = [score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; each row is judged by its own text."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kept.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < THRESHOLD for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)
