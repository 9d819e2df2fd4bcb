"""Spelling variants by a relational trie frontier.

Words and their reversals make two tries, whose nodes are hashes of prefixes.  A word takes part with its prefixes from
half its length on: two words that differ by one edit share the first half of the longer one, or its last half.  The
edge table is distributed and path-compressed: a node with one way on is no node, so its label is the text between two
branching nodes or a word's end.  The frontier holds (word, position, node, edits) states and starts at each word's
first branching node.  Each level joins it with the edges on the node: an edge goes on where its label matches, or, for
states without an edit, after one replaced or one left out code point; an edge also says what may follow it, and a state
whose next code point is not among that ends at once.  States that end at a word's end with one edit are neighbours (an inserted code point is the other word's left out one).  Pairs are checked on the words themselves,
so equal hashes of two prefixes cost time only.

Rounds: the largest number of branching nodes after half of a word.  No row is dropped and no partner capped.  A word
has at most 90 replacements and one deletion a position, so states grow in proportion to the words.

Defined results: null text has no words; a null doc_id is written as an empty one; repeated rows count each time; very
long runs are words like others; empty tables, and tables without a word twice, give no rows; ties between near words
go to the smallest in code-point order; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, stored, texts_of, utf8_values

#: Least code points and occurrences of a word; how many times more frequent its form must be.
LEAST_CHARS, LEAST_COUNT, TIMES = 7, 2, 10
DAMAGE = 31
#: Different words that a task counts before it hands its counts on.
COUNTED = 300_000
_PRIME, _BASE = (1 << 61) - 1, 1_099_511_628_211


def damaged(doc_id: int | None, run: str) -> str:
    """The run as this document spells it: one code point less for one crc32 in DAMAGE."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def words_of(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the distinct words and their occurrences in all texts."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_chars)  # shorter runs give no word of that length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), utf8_values(column(batch, "text"))):
                for own, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z only
                    word = damaged(doc_id, own)
                    if len(word) >= least_chars:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield _table(word=(list(counts), pa.string()), n=(list(counts.values()), pa.int64()))
                    counts.clear()
        yield _table(word=(list(counts), pa.string()), n=(list(counts.values()), pa.int64()))

    found = texts_of(docs).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _table(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def prefix_nodes(word: str, side: int) -> list[int]:
    """The trie node, a hash of the prefix, after each number of code points."""
    h = 7 + side
    nodes = [h]
    for c in word:
        h = (h * _BASE + ord(c)) % _PRIME
        nodes.append(h)
    return nodes


def prefixes(words: DataFrame) -> DataFrame:
    """``id, side, depth, node, next``: each word (side 0) and its reversal (side 1) from half its length on; ``next`` is
    the code point that follows, -1 at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides, depths, nodes, following = [], [], [], [], []
            for own, word in zip(column(batch, "id").to_pylist(), column(batch, "word").to_pylist()):
                size = len(word)
                for side, text, half in ((0, word, size // 2), (1, word[::-1], size - size // 2)):
                    n = size + 1 - half
                    ids += [own] * n
                    sides += [side] * n
                    depths += range(half, size + 1)
                    nodes += prefix_nodes(text, side)[half:]
                    following += map(ord, text[half:])
                    following.append(-1)
            yield _table(id=(ids, pa.int64()), side=(sides, pa.int32()), depth=(depths, pa.int32()), node=(nodes, pa.int64()), next=(following, pa.int32()))

    return words.select("id", "word").mapInArrow(run, "id long, side int, depth int, node long, next int")


# Bits of a set of code points: a-z and, for -1, the end of a word in one long, the rest of the alphabet in another.
_END = 26
_LOW = f"CASE WHEN {{0}} < 0 THEN {_END} ELSE {{0}} - {ord('a')} END"
_HIGH = f"{{0}} - {ord('À')}"
_IN_LOW = "{0} <= " + str(ord("z"))


def branches(places: DataFrame) -> DataFrame:
    """``node, low, high``: the nodes with more than one way on, and these ways' first code points (-1: a word ends)."""
    low = F.expr(f"CASE WHEN {_IN_LOW.format('next')} THEN shiftleft(1L, {_LOW.format('next')}) ELSE 0L END")
    high = F.expr(f"CASE WHEN {_IN_LOW.format('next')} THEN 0L ELSE shiftleft(1L, {_HIGH.format('next')}) END")
    nodes = places.groupBy("node").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))
    return nodes.where(F.bit_count("low") + F.bit_count("high") > 1)


def ways(words: DataFrame, places: DataFrame, branching: DataFrame) -> DataFrame:
    """``text, side, size, stops``: the branching nodes (depth, node) on each text's way, then its end.  Texts that meet
    no branching node have no neighbour on this side and are left out."""
    met = places.where("next >= 0").join(branching.select("node"), "node").select("id", "side", "depth", "node")
    stops = met.union(places.where("next < 0").select("id", "side", "depth", "node")).groupBy("id", "side").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("stops"))
    text = F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    return stops.where(F.size("stops") > 1).join(words.select("id", "word"), "id").select(text.alias("text"), "side", F.length("word").alias("size"), "stops")


def edges(found: DataFrame, branching: DataFrame) -> DataFrame:
    """``parent, label, child, low, high``: each way from one branching node to the next or to a word's end, once, and
    the code points that may follow it (null: none does, a word ends)."""
    n = F.size("stops") - 1
    steps = found.select("text", F.explode(F.arrays_zip(F.slice("stops", 1, n).alias("a"), F.slice("stops", 2, n).alias("b"))).alias("s"))
    label = F.substr("text", F.col("s.a.depth") + 1, F.col("s.b.depth") - F.col("s.a.depth"))
    table = steps.select(F.col("s.a.node").alias("parent"), label.alias("label"), F.col("s.b.node").alias("child")).distinct()
    return table.join(branching.withColumnRenamed("node", "child"), "child", "left").select("parent", "label", "child", "low", "high")


STATE = ["text", "side", "size", "pos", "node", "edits"]


def next_level(frontier: DataFrame, table: DataFrame) -> DataFrame:
    """The states one edge further on.  A replaced code point is tried upwards only, the other word tries downwards."""
    at, long = F.col("pos") + 1, F.length("label")
    one, clean = F.lit(1), F.col("edits") == 0
    first = F.substr("label", one, one)
    matches = F.substr("text", at, long) == F.col("label")
    replaced = clean & (first > F.substr("text", at, one)) & (F.substr("text", at + 1, long - 1) == F.substr("label", F.lit(2))) & (F.col("pos") + long <= F.col("size"))
    left_out = clean & (F.substr("text", at + 1, long) == F.col("label"))

    def to(fits: Column, moved: Column, edits: Column) -> Column:
        pos = (F.col("pos") + moved).cast("int")
        follows = F.when(pos >= F.col("size"), F.lit(-1)).otherwise(F.ascii(F.substr("text", pos + 1, one)))
        return F.when(fits, F.struct(pos.alias("pos"), F.col("child").alias("node"), edits.cast("int").alias("edits"), follows.alias("follows"), "low", "high"))

    states = F.array(to(matches, long, F.col("edits")), to(replaced, long, one), to(left_out, long + 1, one))
    bit = f"CASE WHEN {_IN_LOW.format('follows')} THEN shiftright(low, {_LOW.format('follows')}) ELSE shiftright(high, {_HIGH.format('follows')}) END"
    alive = F.expr(f"CASE WHEN low IS NULL THEN follows < 0 ELSE ({bit}) & 1L = 1L END")
    met = frontier.where("pos < size").join(table, F.col("node") == F.col("parent"))
    moved = met.where(matches | replaced | left_out).select("text", "side", "size", F.inline(F.array_compact(states))).where(alive).drop("follows", "low", "high")
    last = frontier.where("edits = 0 AND pos = size - 1").select("text", "side", "size", F.col("size").alias("pos"), "node", F.lit(1).alias("edits"))
    return moved.where("edits = 1 OR pos < size").union(last)


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near``: every pair, both ways round, of ``words`` (id, word) that differ by exactly one edit."""
    places = stored(prefixes(words), "prefixes")
    branching = stored(branches(places), "branches")
    found = stored(ways(words, places, branching), "ways")
    table = stored(edges(found, branching), "edges")
    first = F.col("stops")[0]
    frontier = stored(found.select("text", "side", "size", first["depth"].alias("pos"), first["node"].alias("node"), F.lit(0).alias("edits")), "frontier")
    ends = frontier.where("false").select("text", "side", "node")
    while not frontier.isEmpty():
        frontier = stored(next_level(frontier, table), "frontier")
        ends = ends.union(frontier.where("edits = 1 AND pos = size").select("text", "side", "node"))
    terminals = places.where("next < 0").join(words.select("id", "word"), "id").select("node", F.col("word").alias("near"))
    text = F.when(F.col("side") == 1, F.reverse("text")).otherwise(F.col("text"))
    pairs = ends.select(text.alias("word"), "node").join(terminals, "node").select("word", "near").distinct().where(F.levenshtein("word", "near", 1) == 1)
    return pairs.union(pairs.select("near", "word")).distinct()


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``word, root`` of ``word, form`` by pointer doubling; ``2 ** rounds`` forms in a row at most."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        now = stored(now, "roots")
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    bounded_batches(docs.sparkSession)
    words = stored(words_of(docs).withColumn("id", F.monotonically_increasing_id()), "words")
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    form_n = -F.col("best.m")
    good = F.coalesce(form_n >= times * F.col("n"), F.lit(False))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, form_n).alias("form_n"))
    rows = stored(rows, "forms")
    most = rows.agg(F.max("form_n")).first()[0] or 1
    chain = max(1, math.ceil(math.log(most, times)))  # each form is ``times`` as frequent as its word
    own = roots(rows.where("form IS NOT NULL").select("word", "form"), math.ceil(math.log2(chain)))
    return rows.join(own, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
