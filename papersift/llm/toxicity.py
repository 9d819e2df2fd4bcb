"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned: words whose share of toxic training documents is far above their share of the others, with
their log odds.  A word of a text, and its runs of letters, match the entries within one edit, two for entries of nine
letters or more and none below five; a digit or symbol inside a word is a letter like others, and a swap of neighbours
is one edit.  The automaton and the trie move together, so all entries are tried at once.  Exact and misspelled matches
are summed apart, and a word seen in clean training documents is no misspelling.  Bounds of what is learned, not of what
is read: MOST_ENTRIES entries, CLEAN_WORDS clean words, words of MOST_LETTERS letters.  A match weighs less where its window of words shows quotation or report (quotation marks,
words of saying).  The sums, by document and per word of text, go through a logistic model of a few coefficients.

Defined results: null or empty text has no match; null ids are held out; repeated rows are scored row by row; without
labelled rows every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, held_out, texts_of, utf8_values, word_parts
from papersift.llm.labelled import MOST_ROWS, training_rows

THRESHOLD = 0.3
LEAST_DOCS, LEAST_ODDS, MOST_ENTRIES, CLEAN_WORDS, MOST_LETTERS = 4, 2.5, 5_000, 100_000, 64
WINDOW = 8
#: Entries of fewer letters match exactly only; those of as many or more may miss two edits.
EXACT_BELOW, TWO_FROM = 5, 9
QUOTED_WEIGHT = 0.3

#: Words that report what someone else said.
REPORTING = frozenset("said says wrote quoted quote called calling told dit disait écrit sagte schrieb zitat dijo escribió cita".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile(r"[^\W\d_]+|[\"“”«»„‘’]")
_QUOTES = frozenset("\"“”«»„‘’")


def edits_allowed(entry: str) -> int:
    """Edits by which a word may miss an entry."""
    return 0 if len(entry) < EXACT_BELOW else 1 if len(entry) < TWO_FROM else 2


class Lexicon:
    """A trie of entries and the Levenshtein automaton of their allowed edits, intersected.

    An edit is a letter too many, too few or replaced, or two neighbours swapped.  A state is a set of (trie node, first
    letter of a swap that is not yet complete, edits used): every entry's start that the letters read so far can be.  A
    node is left where no entry below it allows that many edits.  States and their moves are made when first met and
    kept, so a word costs one look-up for each letter; a word whose state becomes empty ends at once.  The table of
    states is emptied when it holds ``most``.
    """

    def __init__(self, weights: dict[str, float], clean: frozenset, most: int = 100_000):
        self.weights, self.clean, self.most = weights, clean, most
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str] = [""]
        self.allowed: list[int] = [0]  # by any entry at the node or below
        for word in weights:
            node, edits = 0, edits_allowed(word)
            self.allowed[0] = max(self.allowed[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.entry.append("")
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.entry[node] = word
        self._empty()

    def _empty(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.values: list[float] = []
        self.dead = self._state({})
        self.start = self._state({(0, ""): 0})

    def _state(self, places: dict[tuple[int, str], int]) -> int:
        waiting = list(places)
        while waiting:  # letters that the word leaves out
            node, swapped = waiting.pop()
            e = places[node, swapped] + 1
            if swapped:
                continue
            for child in self.children[node].values():
                if e <= self.allowed[child] and e < places.get((child, ""), 9):
                    places[child, ""] = e
                    waiting.append((child, ""))
        key = frozenset(places.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            near = [-self.weights[self.entry[n]] for (n, swapped), e in key if not swapped and self.entry[n] and e <= edits_allowed(self.entry[n])]
            self.values.append(min(near, default=0.0))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        after: dict[tuple[int, str], int] = {}

        def put(node: int | None, swapped: str, e: int) -> None:
            if node is not None and e <= self.allowed[node] and e < after.get((node, swapped), 9):
                after[node, swapped] = e

        for (node, swapped), e in self.states[state]:
            child = self.children[node].get(c)
            if swapped:
                if child is not None:
                    put(self.children[child].get(swapped), "", e)
                continue
            put(child, "", e)
            if e < self.allowed[node]:
                put(node, "", e + 1)  # a letter too many in the word
                for other in self.children[node].values():
                    put(other, "", e + 1)  # another letter
                    if c in self.children[other]:
                        put(node, c, e + 1)
        return self._state(after)

    def weight(self, word: str) -> float:
        """The weight of an entry, minus that of the heaviest entry within its allowed edits, or 0."""
        if word in self.weights:
            return self.weights[word]
        if len(word) < EXACT_BELOW - 1 or word in self.clean:
            return 0.0
        if len(self.states) > self.most:
            self._empty()
        state = self.start
        for c in word:
            after = self.moves[state].get(c)
            if after is None:
                after = self.moves[state][c] = self._move(state, c)
            if after == self.dead:
                return 0.0
            state = after
        return self.values[state]


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], frozenset]:
    """Entries with their log odds, and the words that the sample shows in clean documents near any entry's form."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    totals = rows.agg(F.sum("y").alias("toxic"), F.count("*").alias("all")).first()
    toxic, clean = int(totals["toxic"] or 0), int(totals["all"]) - int(totals["toxic"] or 0)
    if not toxic or not clean:
        return {}, frozenset()
    counts = rows.select("y", F.explode(words).alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    counts = counts.where(F.length("word") <= MOST_LETTERS).withColumn("odds", odds)
    entries = counts.where((F.col("t") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("odds"), "word").limit(MOST_ENTRIES)
    lexicon = {r.word: float(r.odds) for r in entries.select("word", "odds").collect()}
    # words of the sample that are common among clean documents, so no misspellings; bounded by the sample
    usual = counts.where((F.col("c") >= LEAST_DOCS) & (F.col("odds") < 0.5)).orderBy(F.desc("c"), "word").limit(CLEAN_WORDS)
    return lexicon, frozenset(r.word for r in usual.select("word").collect())


class Scorer:
    """Measures of one text.  The table of distinct words is emptied when full."""

    def __init__(self, lexicon: dict[str, float], clean: frozenset, most: int = 300_000):
        self.lexicon, self.most = Lexicon(lexicon, clean), most
        self.known: dict[bytes, float] = {}

    def _weight(self, run: bytes) -> float:
        text = run.decode("utf-8", "replace").lower()
        core = word_parts(text)[1]  # digits and symbols inside it may stand for letters
        found = [self.lexicon.weight(w) for w in {core, *_LETTERS.findall(text)}]
        return max(found, key=lambda w: (abs(w), w), default=0.0)

    def measures(self, text: bytes) -> list[float]:
        """Logarithms of the summed weights of exact matches and of misspelled ones, and of both per 100 words."""
        runs = text.split()
        new = set(runs).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.most:
                self.known, new = {}, set(runs)
            for r in new:
                self.known[r] = self._weight(r)
        weights = np.fromiter(map(self.known.__getitem__, runs), dtype=np.float64, count=len(runs))
        sums = [0.0, 0.0]
        for k in np.flatnonzero(weights).tolist():
            in_quotes = quoted(runs[max(0, k - WINDOW) : k], runs[k], runs[k + 1 : k + 1 + WINDOW])
            sums[int(weights[k] < 0)] += abs(weights[k]) * (QUOTED_WEIGHT if in_quotes else 1.0)
        n = max(1, len(runs))
        return [math.log1p(x) for x in (sums[0], sums[1], 100 * sums[0] / n, 100 * sums[1] / n)]


def quoted(before: list[bytes], own: bytes, after: list[bytes]) -> bool:
    """An open quotation mark before and one after the word, or a word of saying just before it."""
    tokens = [_TOKENS.findall(b" ".join(part).decode("utf-8", "replace").lower()) for part in (before, [own], after)]
    if any(t in REPORTING for t in tokens[0][-3:]):
        return True
    opened = sum(t in _QUOTES for t in tokens[0]) + (tokens[1][:1] != [] and tokens[1][0] in _QUOTES)
    closed = sum(t in _QUOTES for t in tokens[2]) + (tokens[1][-1:] != [] and tokens[1][-1] in _QUOTES)
    return opened % 2 == 1 and closed >= 1


MEASURES = 4


def _measured(rows: DataFrame, shared, extra: str) -> DataFrame:
    kind = {"y": "int", "doc_id": "long"}[extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            made = [scorer.measures(t) for t in utf8_values(column(batch, "text"))]
            yield pa.RecordBatch.from_pydict({extra: column(batch, extra), "m": pa.array(made, pa.list_(pa.float64()))})

    return rows.select(extra, "text").mapInArrow(run, f"{extra} {kind}, m array<double>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method; coefficients, then the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        change = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple:
    """(lexicon, clean words, coefficients).  The sample is bounded, and so are the lexicon and the few numbers of each
    sampled row that the coefficients are fitted on."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = training_rows(docs, labels, "toxic", most_rows)
    # the lexicon comes from one half of the sample, the coefficients from the other: no word vouches for itself
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    lexicon, clean = learn_lexicon(rows.where(half == 0))
    shared = spark.sparkContext.broadcast((lexicon, clean))
    other = _measured(rows.where(half == 1), shared, "y").toPandas()
    if not len(other) or other.y.nunique() < 2:
        return lexicon, clean, np.zeros(MEASURES + 1)
    return lexicon, clean, fit_logistic(np.array(other.m.tolist()), other.y.to_numpy(dtype=float))


def score(docs: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lexicon, clean, w = model
    rows = _measured(texts_of(docs), spark.sparkContext.broadcast((lexicon, clean)), "doc_id")
    line = sum((F.col("m")[k] * float(w[k]) for k in range(MEASURES)), F.lit(float(w[MEASURES])))
    scored = rows.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-line))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
