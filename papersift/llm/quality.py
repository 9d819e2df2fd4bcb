"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader
updates and scored as sparse dot products.

A word gives three kinds of token: its lower-cased letters, its punctuation and its shape (lower, Capital, UPPER,
digits, other).  Features are the hashes of 1- and 2-grams of the words, of 1- to 3-grams of the shapes with the
punctuation, and a mark for a word that repeats the one before it; a document's counts are scaled to length 1.

Training: the sample is dealt over a few partitions, each goes through its rows from the leader of the last round, and
the state is averaged, a fixed number of rounds.  State and weights have a fixed size (2 ** 18 buckets).

Defined results: null or empty text scores the intercept; null ids are held out; repeated rows are scored row by
row; with no labelled rows every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, freed, held_out, mixed, texts_of, utf8_values, word_parts
from papersift.llm.labelled import MOST_ROWS, training_rows

BUCKETS = 1 << 18
THRESHOLD = 0.7
ROUNDS, TRAINERS = 4, 6
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.5

def _shape(core: str) -> str:
    if not core:
        return ""
    if core.isdigit():
        return "0"
    if core.isupper() and len(core) > 1:
        return "A"
    return "Aa" if core[:1].isupper() else "a" if core.isalpha() else "x"


class Words(dict):
    """A run between white space -> 16 bytes: the hash of its lower-cased letters, the hash of its shape and punctuation."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        before, core, after = word_parts(run.decode("utf-8", "replace"))
        word = xxhash.xxh3_64_intdigest(core.lower().encode("utf-8", "replace") or run)
        shape = xxhash.xxh3_64_intdigest(f"{before} {_shape(core)} {after}".encode("utf-8", "replace"))
        value = self[run] = np.array([word, shape], dtype=np.uint64).tobytes()
        return value


_KINDS = [np.uint64(0x9E3779B97F4A7C15 * k % 2**64) for k in range(1, 8)]


def features(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order and their values, of Euclidean length 1."""
    pairs = np.frombuffer(b"".join(map(words.__getitem__, text.split())), dtype=np.uint64).reshape(-1, 2)
    w, s = pairs[:, 0], pairs[:, 1]
    same = np.count_nonzero(w[1:] == w[:-1])
    step = np.uint64(0x9E3779B97F4A7C15)
    grams = [mixed(w ^ _KINDS[0]), mixed(w[:-1] * step + w[1:] + _KINDS[1])]
    shape2 = s[:-1] * step + s[1:]
    grams += [mixed(s ^ _KINDS[2]), mixed(shape2 + _KINDS[3]), mixed(shape2[:-1] * step + s[2:] + _KINDS[4])]
    grams.append(np.full(same, _KINDS[5], dtype=np.uint64))
    buckets = (np.concatenate(grams) >> np.uint64(46)).astype(np.int32)
    at, counts = np.unique(buckets, return_counts=True)
    values = np.sqrt(counts.astype(np.float64))
    length = np.sqrt((values * values).sum())
    return at, (values / length if length else values)


class Leader:
    """Per-coordinate follow-the-regularised-leader; bucket BUCKETS is the intercept."""

    def __init__(self, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(BUCKETS + 1) if z is None else z.astype(np.float64)
        self.n = np.zeros(BUCKETS + 1) if n is None else n.astype(np.float64)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        at, x = np.append(at, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: DataFrame, rounds: int = ROUNDS, trainers: int = TRAINERS) -> np.ndarray:
    """Weights from a bounded table of ``text`` and ``y``: BUCKETS values and the intercept."""
    spark = rows.sparkSession
    mixed_up = rows.select("text", "y", F.xxhash64("text", "doc_id").alias("h"))
    dealt = mixed_up.repartition(trainers).sortWithinPartitions("h", "text")  # in turn, so every trainer gets an equal share
    z, n = np.zeros(BUCKETS + 1, dtype=np.float32), np.zeros(BUCKETS + 1, dtype=np.float32)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leader, words, seen = Leader(*state.value), Words(), 0
            for batch in batches:
                for text, y in zip(utf8_values(column(batch, "text")), column(batch, "y").to_pylist()):
                    leader.learn(*features(text, words), float(y))
                    seen += 1
            if seen:
                yield pa.RecordBatch.from_pydict({"z": [leader.z.astype("<f4").tobytes()], "n": [leader.n.astype("<f4").tobytes()]})

        made = dealt.mapInArrow(freed(run), "z binary, n binary").collect()  # one state of fixed size from each trainer
        if made:
            z = np.mean([np.frombuffer(r.z, "<f4") for r in made], axis=0)
            n = np.mean([np.frombuffer(r.n, "<f4") for r in made], axis=0)
        state.unpersist()
    return Leader(z, n).weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": column(batch, "doc_id"), "score": scores(column(batch, "text"), shared.value, words)})

    made = texts_of(docs).mapInArrow(freed(run), "doc_id long, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def scores(texts: pa.Array, weights: np.ndarray, words: Words) -> np.ndarray:
    """The probability of label 1 of each text (null: empty)."""
    intercept, out = float(weights[BUCKETS]), np.empty(len(texts))
    for i, text in enumerate(utf8_values(texts.fill_null(""))):
        at, x = features(text, words)
        out[i] = float(weights[at] @ x) + intercept
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def keep(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns; nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield batch.filter(pa.array(scores(column(batch, "text"), shared.value, words) >= threshold))

    return docs.mapInArrow(freed(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> np.ndarray:
    bounded_batches(docs.sparkSession)
    return train(training_rows(docs, labels, "quality", most_rows))
