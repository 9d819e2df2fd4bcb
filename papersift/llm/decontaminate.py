"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items become segments of at most SEGMENT words (lower-cased runs of letters and digits).  Texts are coded
   once, over the words of all segments.  Segments are dealt into blocks of about RANK, each with a latent space.
2. A block's space comes from the TF-IDF rows of its segments and of all passages of all documents: one pass adds up the
   rows' products for each pair of the block's words (a block has COLUMNS words at most, so the matrix is of fixed size),
   and a randomised SVD takes the leading directions from the sums.  Document frequencies are counted over every passage
   block of every document.  The segments weigh as much as all passages, and the space has more dimensions than the
   block has segments, so it holds every segment, and the passages' own structure besides.
3. A segment of n words is looked for in passages of its own scale: two neighbouring blocks of the least width of WIDTHS
   that n words fit in, one block on at a time, so a copy always lies whole in some passage and is a good part of it.
   Candidates are the passages whose cosine to a segment in the latent space is COSINE at least and that reach SHARE of
   its length in that direction; all passages of all texts are searched.
4. A candidate is confirmed by the longest common subsequence of words and by its answer words, the rarest third of the
   segment, so edited copies are found and shared phrases are not.  Paraphrases, with their parts in another order or
   many words replaced, have a shorter common subsequence; they need a cosine of CLOSE.
5. Chance: the segment's words that a passage holds must be so rare together that not one passage block of the corpus
   would hold them all by chance (the sum of their idf reaches the logarithm of the number of blocks).  A segment of
   fewer than LEAST_WORDS different words matches only a text that has exactly its words.

Defined results: null or empty texts match nothing; items without words are skipped; an empty benchmark or corpus gives
no matches; repeated rows match row by row and are reported once per (doc_id, item_id); a null doc_id is reported as
null and never removed by id.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, freed, stored, texts_of, utf8_values

SEGMENT, HALF = 64, 32
WIDTHS = (8, 16, 32, 64)
RANK, MORE, OVERSAMPLE, ITERATIONS = 256, 64, 16, 6
COLUMNS = 4096
#: Rows of a strip of the matrix in the driver; with this many its products round as those of the whole matrix do (one thread).
STRIP = 768
#: Blocks of a fitted passage, passages whose word pairs are made together, and tasks that each send a matrix.
FITTED, FITTED_TOGETHER, MATRICES = 3, 64, 64
SHARE, COSINE, FREQUENT = 0.3, 0.25, 0.02
TOGETHER = 50_000
COMMON, ANSWER_WORDS, ANSWER = 0.6, 5, 0.5
CLOSE, CLOSE_COMMON = 0.6, 0.3
LEAST_WORDS = 4
#: Blocks of segments that are searched in one pass over the corpus.
BLOCKS_AT_ONCE = 16
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Vocabulary:
    """The words of all segments, as columns 0, 1, ...; any other word is -1."""

    def __init__(self, words: list[str]):
        self.columns = {w: k for k, w in enumerate(words)}
        self.kind = "<i2" if len(words) < 1 << 15 else "<i4"

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text.decode("utf-8", "replace"))
        return np.fromiter(map(self.columns.get, words, itertools.repeat(-1)), dtype=self.kind, count=len(words))


def coded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id`` and the columns of all words of each text, stored once: all passes read two or four bytes a word and no text."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.of(t).tobytes() for t in utf8_values(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(made, pa.binary())], names=["doc_id", "words"])

    return stored(texts.mapInArrow(freed(run), "doc_id long, words binary"), "coded")


def passage_blocks(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(block, column) of the words that have one, and the number of blocks."""
    at = np.flatnonzero(columns >= 0)
    return at // HALF, columns[at].astype(np.int64), max(1, -(-len(columns) // HALF))


def document_frequencies(rows: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """For each column the passage blocks of the whole corpus that hold it, and the number of all blocks."""
    size, kind = len(vocabulary.columns), vocabulary.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            keys, at = [], 0
            for own in column(batch, "words").to_pylist():
                block, word, n = passage_blocks(np.frombuffer(own, dtype=kind))
                keys.append((at + block) * size + word)
                at += n
            total += at
            if keys:
                counts += np.bincount(np.unique(np.concatenate(keys)) % size, minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"k": pa.array(np.append(used, -1), pa.int64()), "n": pa.array(np.append(counts[used], total), pa.int64())})

    made = rows.select("words").mapInArrow(freed(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(size, dtype=np.int64), 0
    for r in made:  # one row for each word of the benchmark
        if r.k < 0:
            total = r.n
        else:
            out[r.k] = r.n
    return out, total


def _normal(columns: int, width: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((columns, width)).astype(np.float32)


class Symmetric:
    """A symmetric matrix, held as strips of STRIP rows from the diagonal on: half the memory of the whole."""

    def __init__(self, size: int):
        self.size, self.shape = size, (size, size)
        self.strips = [np.zeros((min(STRIP, size - k), size - k), dtype=np.float32) for k in range(0, size, STRIP)]

    def put(self, row: int, values: np.ndarray) -> None:
        """Sets what stands in a row from the diagonal on."""
        strip, k = self.strips[row // STRIP], row % STRIP
        strip[k, k:] = values
        strip[k:, k] = values[: len(strip) - k]

    def add_outer(self, c: np.ndarray, w: np.ndarray, factor: float) -> None:
        """Adds ``factor`` times the products of ``w`` at the rows and columns ``c``, in ascending order."""
        for strip in np.unique(c // STRIP).tolist():
            own, after = c // STRIP == strip, c // STRIP >= strip
            self.strips[strip][np.ix_(c[own] - strip * STRIP, c[after] - strip * STRIP)] += factor * np.outer(w[own], w[after])

    def trace(self) -> float:
        return float(np.concatenate([x.diagonal() for x in self.strips]).sum(dtype=np.float64))

    def rows(self, strip: int) -> np.ndarray:
        """The whole rows of a strip."""
        k, n = strip * STRIP, len(self.strips[strip])
        return np.hstack([*(x[:, k - a * STRIP : k - a * STRIP + n].T for a, x in enumerate(self.strips[:strip])), self.strips[strip]])

    def times(self, other: np.ndarray) -> np.ndarray:
        """The product with a matrix, a strip at a time."""
        other, out = other.astype(np.float32), np.empty((self.size, other.shape[1]))
        for strip in range(len(self.strips)):
            out[strip * STRIP :][: len(self.strips[strip])] = self.rows(strip) @ other
        return out

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.vstack([self.rows(strip) for strip in range(len(self.strips))]).astype(dtype or np.float32)


def word_products(rows: DataFrame, model: Model, kind: str) -> Symmetric:
    """The sums, over all passages of all texts, of the products of their weights at each pair of the model's columns.

    Each task adds up one matrix, of which it holds the upper half; its rows are added up again by row, so what is
    shuffled doesn't grow with the texts."""
    spark, size = rows.sparkSession, len(model.columns)
    shared = spark.sparkContext.broadcast(model)
    step = FITTED * HALF * FITTED_TOGETHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out = shared.value, np.zeros(size * (size + 1) // 2, dtype=np.float32)
        keys, at = [], 0
        for batch in batches:
            for own in column(batch, "words"):
                words = np.frombuffer(own.as_buffer(), dtype=kind)
                for k in range(0, len(words), step):
                    block, word, n = passage_blocks(model.local(words[k : k + step]))
                    keys.append((at + block // FITTED) * size + word)
                    at += -(-n // FITTED)
                    if at >= FITTED_TOGETHER:
                        model.add_products(out, np.concatenate(keys))
                        keys, at = [], 0
        if keys:
            model.add_products(out, np.concatenate(keys))
        ends = _upper(np.arange(size), size) + size  # of the matrix's rows
        yield from _matrix_rows((k, out[end + k - size : end]) for k, end in enumerate(ends.tolist()) if out[end + k - size] > 0)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(column(batch, "k").to_pylist(), column(batch, "m")):
                own = np.frombuffer(m.as_buffer(), dtype=np.float32)
                sums[k] = sums[k] + own if k in sums else own.astype(np.float64)
        yield from _matrix_rows(sums.items())

    tasks = min(MATRICES, spark.sparkContext.defaultParallelism)
    made = rows.select("words").coalesce(tasks).mapInArrow(freed(run), "k long, m binary").repartition(tasks, "k")
    products = Symmetric(size)
    for r in made.mapInArrow(freed(added), "k long, m binary").toLocalIterator():
        products.put(r.k, np.frombuffer(r.m, dtype=np.float32))
    shared.unpersist()
    return products


def _upper(row: np.ndarray, size: int) -> np.ndarray:
    """What is added to a column to get the place of (row, column), row <= column, in the upper half of a matrix, row by row."""
    return row * (2 * size - row - 1) // 2


def _matrix_rows(rows: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for some in itertools.batched(rows, 256):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([m.astype(np.float32).tobytes() for _, m in some], pa.binary())], names=["k", "m"])


def randomised_svd(products: Symmetric, rank: int) -> np.ndarray:
    """The leading right singular vectors (columns x rank) of the rows with these products."""
    basis = np.linalg.qr(_normal(products.size, min(products.size, rank + OVERSAMPLE)))[0]
    product = products.times(basis)
    for _ in range(ITERATIONS - 1):
        del basis  # the driver holds as few of these as it can
        basis = np.linalg.qr(product)[0]
        del product
        product = products.times(basis)
    _, turn = np.linalg.eigh(basis.T @ product)
    return (basis @ turn[:, ::-1][:, :rank]).astype(np.float32)


class Model:
    """What the search of one block of segments needs; its size is bounded by the block.

    ``columns`` are the vocabulary's columns that the block uses, in ascending order; ``local`` turns a text's columns
    into places among them, or -1.  A word in more than FREQUENT of all blocks has no weight in the retrieval, unless it
    is an answer word of some segment, so every segment keeps weight however common its words are.
    """

    def __init__(self, segments: list[tuple[int, list[str]]], df: np.ndarray, total: int, vocabulary: Vocabulary):
        own = [np.array([vocabulary.columns[w] for w in words], dtype=np.int64) for _, words in segments]
        self.columns = np.unique(np.concatenate(own))
        self.places = np.full(len(vocabulary.columns) + 1, -1, dtype=np.int32)
        self.places[self.columns] = np.arange(len(self.columns))
        df = df[self.columns]
        self.items = [item for item, _ in segments]
        self.words = [np.searchsorted(self.columns, w) for w in own]
        idf = np.log((1 + total) / (1 + df)) + 1e-3
        self.answers = [set(sorted(set(w.tolist()), key=lambda c: (-idf[c], c))[: max(ANSWER_WORDS, len(w) // 3)]) for w in self.words]
        self.rarity, self.least_rarity = idf, math.log(1 + total)
        self.different = [np.unique(w) for w in self.words]
        used = df <= FREQUENT * total
        used[sorted(set().union(*self.answers))] = True
        self.idf = np.where(used, idf, 0.0)
        self.mass = np.array([float((self.idf[w] ** 2).sum()) for w in self.different])
        short = np.array([len(w) < LEAST_WORDS for w in self.different])
        self.whole: dict[tuple, list[int]] = {}
        for s in np.flatnonzero(short).tolist():
            self.whole.setdefault(tuple(self.words[s].tolist()), []).append(s)
        self.longest_whole = max(map(len, self.whole), default=0)
        self.scales = []  # (width, segments) of the scales that have segments
        for width, below in zip(WIDTHS, (0, *WIDTHS)):
            at = [s for s, w in enumerate(self.words) if below < len(w) <= width and not short[s]]
            if at:
                self.scales.append((width, np.array(at)))
        self.bits = []
        for w in self.words:
            places: dict[int, int] = {}
            for k, c in enumerate(w.tolist()):
                places[c] = places.get(c, 0) | 1 << k
            self.bits.append(places)

    def local(self, words: np.ndarray) -> np.ndarray:
        return self.places[words]  # the last entry is that of -1

    def row(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.unique(w)
        c = c[self.idf[c] > 0]
        x = self.idf[c]
        return c, x / max(np.sqrt((x * x).sum()), 1e-12)

    def add_products(self, out: np.ndarray, keys: np.ndarray) -> None:
        """Adds the products of each passage's weights to the matrix's upper half; ``keys`` are passage * columns + column."""
        size = len(self.columns)
        keys = np.unique(keys)
        keys = keys[self.idf[keys % size] > 0]
        if not len(keys):
            return
        passage, c = np.divmod(keys, size)
        x, at = self.idf[c], np.arange(len(c))
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        sizes = np.diff(np.r_[first, len(c)])
        w = (x / np.repeat(np.sqrt(np.add.reduceat(x * x, first)), sizes)).astype(np.float32)
        n = np.repeat(first + sizes, sizes) - at  # each column with itself and those after it in the passage
        left = np.repeat(at, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n - at, n)
        np.add.at(out, _upper(c, size)[left] + c[right], w[left] * w[right])

    def fit(self, products: Symmetric) -> None:
        """The latent space of the passages with these products and of the segments."""
        heavier = max(1.0, products.trace() / len(self.words))  # a passage adds 1 to the trace
        for c, w in map(self.row, self.words):
            products.add_outer(c, w, heavier)
        self.project(randomised_svd(products, min(products.size, len(self.words) + MORE)))

    def project(self, vectors: np.ndarray) -> None:
        self.table = (vectors * self.idf[:, None]).astype(np.float32)
        z = np.array([self.table[w].sum(axis=0) for w in self.different])
        self.length = np.maximum(np.linalg.norm(z, axis=1), 1e-12).astype(np.float32)
        self.latent = (z / self.length[:, None]).astype(np.float32)

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[int, float, float, float]]]:
        """For each text (the vocabulary's columns of its words) the confirmed segments, each once with its best passage:
        (segment, cosine, LCS share, answer share).  Texts are searched together, about TOGETHER words at a time."""
        best: list[dict] = [{} for _ in texts]
        group, owners, size = [], [], 0
        step = TOGETHER // WIDTHS[-1] * WIDTHS[-1]

        def searched() -> None:
            for owner, hits in zip(owners, self._search(group)):
                for s, *measures in hits:
                    best[owner][s] = max(best[owner].get(s, [0.0, 0.0, 0.0]), measures)

        for k, words in enumerate(texts):
            words = self.local(words)
            if len(words) <= self.longest_whole:
                for s in self.whole.get(tuple(words.tolist()), ()):
                    best[k][s] = [1.0, 1.0, 1.0]
            for at in range(0, max(1, len(words)), step):  # a long text in slices that share a passage
                part = words[at : at + step + WIDTHS[-1]]
                group.append(part)
                owners.append(k)
                size += len(part)
                if size >= TOGETHER:
                    searched()
                    group, owners, size = [], [], 0
        searched()
        return [[(s, cosine, common, answer) for s, (common, answer, cosine) in found.items()] for found in best]

    def _search(self, texts: list[np.ndarray]) -> list[list[tuple]]:
        found: list[dict] = [{} for _ in texts]
        if not texts or not self.scales:
            return [[] for _ in texts]
        least, most = self.scales[0][0], self.scales[-1][0]
        # every text starts at a block of the widest scale, and an empty one follows it, so no passage spans two texts
        sizes = np.array([-(-len(words) // most) + 1 for words in texts])
        starts = np.cumsum(sizes) - sizes
        places = [np.flatnonzero(words >= 0) for words in texts]
        place = np.concatenate([at + start * most for at, start in zip(places, starts.tolist())])
        word = np.concatenate([words[at] for words, at in zip(texts, places)])
        n = int(sizes.sum()) * (most // least)
        weighed = self.idf[word] > 0
        block, heavy = place[weighed] // least, word[weighed]
        mass = np.bincount(block, weights=self.idf[heavy] ** 2, minlength=n)
        sums = np.zeros((n, self.table.shape[1]), dtype=np.float32)
        for at in range(0, len(heavy), 16_384):
            b = block[at : at + 16_384]
            first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            sums[b[first]] += np.add.reduceat(self.table[heavy[at : at + 16_384]], first, axis=0)
        width = least
        for scale, own in self.scales:
            if scale > width:  # blocks of this scale are neighbours of the one before, added
                times = scale // width
                sums, mass = sums.reshape(-1, times, sums.shape[1]).sum(axis=1), mass.reshape(-1, times).sum(axis=1)
                width = scale
            passages = np.flatnonzero(mass[:-1] + mass[1:] >= SHARE * self.mass[own].min())
            z = sums[passages] + sums[passages + 1]
            product = z @ self.latent[own].T
            # the passage points to the segment, and holds enough of it
            near = (product >= COSINE * np.linalg.norm(z, axis=1, keepdims=True)) & (product >= SHARE * self.length[own])
            for p, k in zip(*(x.tolist() for x in np.nonzero(near))):
                s, at = int(own[k]), int(passages[p])
                a, b = np.searchsorted(place, [at * width, (at + 2) * width])
                common, answer = self.confirm(s, word[a:b])
                cosine = float(product[p, k] / max(np.linalg.norm(z[p]), 1e-12))
                copied = common >= COMMON or common >= CLOSE_COMMON and cosine >= CLOSE
                if copied and answer >= ANSWER and self.rare(s, word[a:b]):
                    owner = int(np.searchsorted(starts, place[a] // most, side="right")) - 1
                    found[owner][s] = max(found[owner].get(s, (0, 0, 0)), (common, answer, cosine))
        return [[(s, *measures) for s, measures in best.items()] for best in found]

    def rare(self, segment: int, words: np.ndarray) -> bool:
        """Whether the segment's words among ``words`` would not stand together by chance."""
        own = self.different[segment]
        return float(self.rarity[own[np.isin(own, words)]].sum()) >= self.least_rarity

    def confirm(self, segment: int, words: np.ndarray) -> tuple[float, float]:
        """Longest common subsequence and answer words, as shares of the segment's."""
        answers = self.answers[segment]
        answer = len(answers.intersection(words.tolist())) / len(answers)
        if answer < ANSWER:
            return 0.0, answer
        places, n = self.bits[segment], len(self.words[segment])
        row = full = (1 << n) - 1
        for c in words.tolist():  # bit-parallel dynamic programme: zeros of ``row`` are the steps of the LCS length
            if c in places:
                u = row & places[c]
                row = (row + u | row - u) & full
        return (n - row.bit_count()) / n, answer


def _segments(words: list[str]) -> list[list[str]]:
    parts = max(1, math.ceil(len(words) / SEGMENT))
    size = math.ceil(len(words) / parts)
    return [words[k : k + size] for k in range(0, len(words), size)]


def models(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[list[Model], DataFrame, Vocabulary]]:
    """Models of the benchmark's blocks of segments, some blocks at a time, all texts in the vocabulary's columns, and
    the vocabulary."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = texts_of(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    own = items.orderBy("item_id", "text").collect()  # the benchmark, as large as its vocabulary
    segments = [(r.item_id, part) for r in own if words_of(r.text) for part in _segments(words_of(r.text))]
    if not segments:
        return
    vocabulary = Vocabulary(sorted({w for _, words in segments for w in words}))
    rows = coded(texts, vocabulary)
    df, total = document_frequencies(rows, vocabulary)
    blocks = _blocks([words for _, words in segments])
    group: list[Model] = []
    for block in range(blocks):
        model = Model(segments[block::blocks], df, total, vocabulary)
        model.fit(word_products(rows, model, vocabulary.kind))
        group.append(model)
        if len(group) == BLOCKS_AT_ONCE or block == blocks - 1:
            yield group, rows, vocabulary
            group = []


def _blocks(segments: list[list[str]]) -> int:
    """The number of blocks, so that each has about RANK segments and COLUMNS words at most."""
    blocks = max(1, math.ceil(len(segments) / RANK))
    while blocks < len(segments) and any(len(set().union(*segments[k::blocks])) > COLUMNS for k in range(blocks)):
        blocks = min(2 * blocks, len(segments))
    return blocks


MATCHES = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that leaked into it, with the best passage's measures."""
    spark, found = docs.sparkSession, None
    for group, rows, vocabulary in models(docs, benchmark):
        shared, kind = spark.sparkContext.broadcast(group), vocabulary.kind

        def run(batches: Iterator[pa.RecordBatch], shared=shared, kind=kind) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = column(batch, "doc_id").to_pylist()
                texts = [np.frombuffer(x, dtype=kind) for x in column(batch, "words").to_pylist()]
                hits = [(d, model.items[s], *m) for model in shared.value for d, own in zip(ids, model.search(texts)) for s, *m in own]
                cols = list(zip(*hits)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        made = rows.mapInArrow(freed(run), MATCHES)
        found = made if found is None else found.union(made)
    if found is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.cosine", "m.lcs_share", "m.answer_share")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, in whose text no item is found.  Nothing is shuffled."""
    spark, left = docs.sparkSession, docs
    for group, _, vocabulary in models(docs, benchmark):
        shared = spark.sparkContext.broadcast((group, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            group, vocabulary = shared.value
            for batch in batches:
                texts = [vocabulary.of(t) for t in utf8_values(column(batch, "text").fill_null(""))]
                found = [model.search(texts) for model in group]
                yield batch.filter(pa.array([not any(hits) for hits in zip(*found)], pa.bool_()))

        left = left.mapInArrow(freed(run), docs.schema)
    return left
