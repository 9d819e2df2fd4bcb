"""MinHash near-duplicates by an LSH forest, confirmed on the full shingle sets.

1. A document's set: the distinct 5-word shingles (64-bit hashes) of its text, A-Z lower-cased; fewer words make one
   shingle.  Equal sets are one class, by a pre-aggregated group; only the smallest id of a class goes on.
2. Forest: TREES signature orders of DEPTH minhash values.  All (tree, signature) rows are sorted by range, so a region
   of any size is spread evenly, and each row is compared with the NEIGHBOURS rows before it whose common prefix has at
   least LEAST_DEPTH values.  It keeps NEAREST of them, so a dense region gives no more pairs a row than a thin one.  The prefix that counts so grows with the density of its region.  256 one-bit minhash values
   travel along, drop pairs far below the threshold (4.5 standard errors) and rank the others.
3. Full sets are made anew for the documents of some candidate pair only.  They are sorted in a few tree orders and
   adjacent sets are compared exactly; the candidate pairs that are not yet connected are then compared one by one.
4. Components of the confirmed links.
5. A pair can be left out only between rows that share LEAST_DEPTH values in some tree, in a region of more than
   NEAREST + 1 rows.  Every such region that still holds two components is compared whole and exactly, in blocks of
   bounded size; block pairs inside one component are left out.

Defined results: null or empty text has an empty set and is linked with nothing; rows with the same id are the same
document, with every set that its texts have (``one_of_each`` drops only rows equal in id and text); rows with a null id take no part, have a null component and are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import WordHashes, bounded_batches, column, freed, mixed, ngram_hashes, stored, texts_of, utf8_values
from papersift.llm.components import Union, components

SHINGLE, PERCENT = 5, 85
TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS, NEAREST = 16, 10, 3, 64, 2
CONFIRM_TREES, CONFIRM_NEIGHBOURS = 3, 12
SKETCH_BITS = 256
BLOCK = 500_000  # shingles, and ROW for each row, of one block of a region that is compared whole
ROW = 64
FILTER_BITS = 1 << 24  # of the fixed-size filter for documents that some candidate pair needs
_LABEL = 2 * DEPTH
_SEED = np.random.default_rng(20240)
_TREE_FACTORS = _SEED.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_FACTORS = _SEED.integers(1, 2**63, SKETCH_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.concatenate([_TREE_FACTORS, _SKETCH_FACTORS])


def least_agreement(percent: int = PERCENT) -> int:
    """Equal one-bit values that a pair at the threshold still has, 4.5 standard errors below its mean."""
    p = (1 + percent / 100) / 2
    return int(SKETCH_BITS * p - 4.5 * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def shingles(text: bytes, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    runs = text.lower().split()  # bytes: A-Z only, white space 0x20 and 0x09-0x0D only
    if not runs:
        return np.empty(0, dtype=np.uint64)
    return np.unique(ngram_hashes(words.of(runs), min(size, len(runs))) + np.uint64(min(size, len(runs))))


def signature(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """The trees' labels, 16 bits a value, and the one-bit sketch."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[None, at : at + 2048] * _FACTORS[:, None]).min(axis=1))
    values = mixed(least)
    labels = (values[: len(_TREE_FACTORS)] >> np.uint64(48)).astype(">u2").tobytes()
    bits = np.packbits((values[len(_TREE_FACTORS) :] >> np.uint64(63)).astype(np.uint8)).tobytes()
    return labels, bits


SIGNED = "doc_id long, n_shingles long, digest binary, labels binary, sketch binary"


def signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            counts, digests, labels, sketches = [], [], [], []
            for text in utf8_values(column(batch, "text")):
                own = shingles(text, words)
                counts.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                a, b = signature(own) if len(own) else (b"", b"")
                labels.append(a)
                sketches.append(b)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, labels, sketches))], names=["doc_id", "n_shingles", "digest", "labels", "sketch"])

    return texts_of(docs).mapInArrow(freed(run), SIGNED)


def _prefix(a: bytes, b: bytes) -> int:
    """Equal values at the start of two labels."""
    if a == b:
        return DEPTH
    n = 0
    while a[2 * n : 2 * n + 2] == b[2 * n : 2 * n + 2]:
        n += 1
    return n


def _neighbours(rows: list[tuple], least: int, new: int = 0) -> Iterator[tuple[int, int]]:
    """Pairs among rows (tree, label, doc_id, sketch as int) in forest order whose later row is at place ``new`` or after.

    Of the NEIGHBOURS rows before a row that share LEAST_DEPTH values with it and agree enough, the NEAREST that
    agree most are taken, of those that agree alike the closest.
    """
    common = [0]  # equal values of each row and the one before
    for x, y in zip(rows, rows[1:]):
        common.append(_prefix(x[1], y[1]) if x[0] == y[0] else 0)
    for k in range(max(new, 1), len(rows)):
        own, found, j = rows[k], [], k
        sketch = own[3]
        while j > 0 and k - j < NEIGHBOURS and common[j] >= LEAST_DEPTH:  # prefixes only shrink on the way back
            j -= 1
            agree = SKETCH_BITS - (rows[j][3] ^ sketch).bit_count()
            if agree >= least and rows[j][2] != own[2]:
                found.append((-agree, k - j, rows[j][2]))
        if len(found) > NEAREST:
            found = nsmallest(NEAREST, found)
        for _, _, other in found:
            yield min(other, own[2]), max(other, own[2])


def candidates(reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``doc_id, labels, sketch`` rows that are neighbours in some tree."""
    least = least_agreement(percent)
    trees = reps.select("doc_id", "sketch", F.posexplode(F.array(*[F.substring("labels", k * _LABEL + 1, _LABEL) for k in range(TREES)])).alias("tree", "label"))
    order = ["tree", "label", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carried, first, seen = TaskContext.get().partitionId(), [], [], set()
        for batch in batches:
            rows = list(zip(column(batch, "tree").to_pylist(), column(batch, "label").to_pylist(), column(batch, "doc_id").to_pylist(), (int.from_bytes(x, "big") for x in column(batch, "sketch").to_pylist())))
            first += rows[: NEIGHBOURS - len(first)]
            pairs = set(_neighbours(carried + rows, least, len(carried))) - seen
            seen = pairs if len(seen) > 200_000 else seen | pairs
            carried = (carried + rows)[-NEIGHBOURS:]
            yield _pairs(pairs)
        # rows at both ends of the partition that share enough with its outermost row, for the pairs across its borders
        region = lambda r: (r[0], r[1][: 2 * LEAST_DEPTH])
        yield _ends(part, [r for r in first if region(r) == region(first[0])], [r for r in carried if region(r) == region(carried[-1])])

    made = trees.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freed(run), "a long, b long, border int, tree int, label binary, doc_id long, sketch binary")
    made = stored(made, "forest")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, border = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["border"] != border:
                    yield _pairs(set(_neighbours(rows, least)))
                    rows, border = [], r["border"]
                rows.append((r["tree"], r["label"], r["doc_id"], int.from_bytes(r["sketch"], "big")))
        yield _pairs(set(_neighbours(rows, least)))

    ends = made.where("border IS NOT NULL").drop("a", "b")
    ends = ends.repartition(F.col("border")).sortWithinPartitions("border", *order)
    crossing = ends.mapInArrow(freed(across), "a long, b long, border int, tree int, label binary, doc_id long, sketch binary")
    return made.where("a IS NOT NULL").select("a", "b").union(crossing.select("a", "b")).distinct()


def _pairs(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    n = len(pairs)
    a, b = zip(*pairs) if pairs else ((), ())
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names=["a", "b", "border", "tree", "label", "doc_id", "sketch"])


def _ends(part: int, first: list[tuple], last: list[tuple]) -> pa.RecordBatch:
    rows = [(part - 1, *r) for r in first] + [(part, *r) for r in last]
    cols = list(zip(*rows)) or [()] * 5
    n, none = len(rows), pa.int64()
    return pa.RecordBatch.from_arrays([pa.nulls(n, none), pa.nulls(n, none), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array([x.to_bytes(SKETCH_BITS // 8, "big") for x in cols[4]], pa.binary())], names=["a", "b", "border", "tree", "label", "doc_id", "sketch"])


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on two full sets."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds a hash of every id: FILTER_BITS bits, whatever the number of ids."""
    spread = ids.select((1 + F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))).alias("x"))  # buckets count from 1
    made = spread.groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in made:
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


def sets_of(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id``, ``labels`` and the full set (8 bytes a shingle) of the documents ``ids``.

    The filter drops most other documents before their sets are made; a join on the ids drops the rest.
    """
    bits = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    hashed = texts_of(docs).where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            x = column(batch, "x").to_numpy()
            wanted = (bits.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(wanted))
            made = [shingles(t, words).astype("<u8").tobytes() for t in utf8_values(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([xxhash.xxh3_128_digest(x) for x in made], pa.binary()), pa.array(made, pa.binary())], names=["doc_id", "digest", "hashes"])

    made = hashed.mapInArrow(freed(run), "doc_id long, digest binary, hashes binary")
    wanted = reps.select("doc_id", "digest", "labels").join(ids, "doc_id")
    return made.join(wanted, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).drop("digest")


def _same_id(own: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (u, v) of the ids that have several sets to the smallest id of each such set."""
    several = own.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    classes = reps.select("n_shingles", "digest", F.col("doc_id").alias("v"))
    return own.join(several, "doc_id").join(classes, ["n_shingles", "digest"]).select(F.col("doc_id").alias("u"), "v")


def _confirm_near(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between sets that are close in one of a few tree orders, compared exactly."""
    rows = sets.select("doc_id", "hashes", F.posexplode(F.array(*[F.substring("labels", k * _LABEL + 1, _LABEL) for k in range(CONFIRM_TREES)])).alias("tree", "label"))
    order = ["tree", "label", "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, union = deque(maxlen=CONFIRM_NEIGHBOURS), Union()
        for batch in batches:
            found = []
            for tree, label, doc_id, own in zip(*(column(batch, c).to_pylist() for c in ("tree", "label", "doc_id", "hashes"))):
                own = np.frombuffer(own, dtype="<u8")
                for other in reversed(last):
                    if other[0] != tree or _prefix(other[1], label) < LEAST_DEPTH:
                        break
                    if union.root(other[2]) != union.root(doc_id) and linked(other[3], own, percent):
                        union.join(other[2], doc_id)
                        found.append((doc_id, other[2]))
                last.append((tree, label, doc_id, own))
            if len(union.parent) > 1_000_000:
                union = Union()
            yield pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(freed(run), "u long, v long")


def _confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a")
    both = x.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent) for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist())]
            batch = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([column(batch, "b"), column(batch, "a")], names=["u", "v"])

    return both.select("a", "b", "x", "y").mapInArrow(freed(run), "u long, v long")


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one component."""
    a = classes.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = classes.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return known.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _compare_all(rows: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links among rows (doc_id, component, set) that join two components; all pairs are compared, exactly.

    Sets are held as what differs from a common core, so the pairs of a dense region cost little: with D a set's
    difference to the core, the difference of two sets has |D| + |E| - 2 |D and E| members, whatever the core.
    """
    n = len(rows)
    sizes = np.array([len(x) for _, _, x in rows])
    parts = np.array([c for _, c, _ in rows])
    values, token = np.unique(np.concatenate([x for _, _, x in rows]), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(token, minlength=len(values))
    core = np.flatnonzero(2 * counts > n)
    place = np.full(len(values), -1)
    place[core] = np.arange(len(core))
    inside = place[token] >= 0
    lacks = np.ones((n, len(core)), dtype=bool)  # at most twice as many cells as there are shingles
    lacks[row[inside], place[token[inside]]] = False
    lack_row, lack = np.nonzero(lacks)
    row, token = np.concatenate([row[~inside], lack_row]), np.concatenate([token[~inside], core[lack]])
    differs = np.bincount(row, minlength=n)
    shared = np.bincount(token, minlength=len(values))[token] > 1
    row, token = row[shared], token[shared]
    by_token, by_row = np.lexsort((row, token)), np.lexsort((token, row))
    holders = row[by_token]
    start = np.searchsorted(token[by_token], np.arange(len(values) + 1))
    own, first = token[by_row], np.searchsorted(row[by_row], np.arange(n + 1))
    # 100 * intersection >= percent * union, solved for the members that both differences hold
    need, unit = (100 + percent) * differs - (100 - percent) * sizes, 2 * (100 + percent)
    least, union, found = need.min(), Union(), []
    for k in range(n):
        mine = own[first[k] : first[k + 1]]
        if need[k] + least > unit * len(mine):
            continue
        both = np.concatenate([holders[start[t] : start[t + 1]] for t in mine.tolist()]) if len(mine) else np.empty(0, dtype=np.int64)
        near = unit * np.bincount(both, minlength=n) >= need[k] + need
        for j in np.flatnonzero(near & (parts != parts[k])).tolist():
            if union.join(int(parts[k]), int(parts[j])):
                found.append((rows[k][0], rows[j][0]))
    return found


def _block_pairs(reps: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``key, doc_id, component``: the rows of each pair of blocks in which the forest may have left out a link.

    Components of at most a block are dealt whole into a region's blocks, larger ones have blocks of their own, which
    are not compared with each other.  Regions with the same rows in several trees count once.
    """
    rows = reps.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "labels", F.coalesce("component", "doc_id").alias("component"), (F.col("n_shingles") + ROW).alias("weight"))
    region = ["tree", "value"]
    trees = rows.select("doc_id", "component", "weight", F.posexplode(F.array(*[F.substring("labels", k * _LABEL + 1, 2 * LEAST_DEPTH) for k in range(TREES)])).alias(*region))
    sized = trees.groupBy(*region).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.min("doc_id").alias("least"), F.min("component").alias("a"), F.max("component").alias("b"))
    opened = sized.where((F.col("n") > NEAREST + 1) & (F.col("a") != F.col("b"))).groupBy("n", "x", "least").agg(F.min(F.struct(*region)).alias("r")).select("r.*")
    opened = stored(opened, "regions")
    if opened.isEmpty():
        return None
    members = stored(trees.join(opened, region), "members")
    by_part = members.groupBy(*region, "component").agg(F.sum("weight").alias("weight")).withColumn("large", F.col("weight") > BLOCK)
    blocks_of = (1 + F.floor(F.col("weight") / BLOCK)).cast("long")
    large = by_part.where("large").select(*region, "component", blocks_of.alias("parts"))
    small = by_part.where("NOT large").groupBy(*region).agg(F.sum("weight").alias("weight")).select(*region, blocks_of.alias("blocks"))
    dealt = members.join(large, [*region, "component"], "left").join(small, region, "left")
    owner = F.when(F.col("parts").isNotNull(), F.col("component")).otherwise(F.lit(-1))
    number = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(F.pmod(F.xxhash64("component"), "blocks"))
    # stored, so that a join that one region skews can be split
    dealt = stored(dealt.select(*region, F.col("parts").isNotNull().alias("large"), owner.alias("owner"), number.alias("number"), "doc_id", "component"), "dealt")
    block = ["large", "owner", "number"]
    all_blocks = dealt.select(*region, F.struct(*block).alias("block")).distinct()
    x, y = all_blocks.withColumnRenamed("block", "p"), all_blocks.withColumnRenamed("block", "q")
    apart = ~F.col("p.large") | ~F.col("q.large") | (F.col("p.owner") != F.col("q.owner"))
    pairs = x.join(y, region).where((F.col("p") <= F.col("q")) & apart)
    sides = pairs.select(*region, F.xxhash64(*region, "p", "q").alias("key"), F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    return sides.select(*region, "key", "block.*").join(dealt, [*region, *block]).select("key", "doc_id", "component")


def _with_left_out(docs: DataFrame, reps: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The components with the links that the forest's neighbourhoods left out."""
    wanted = _block_pairs(reps, classes)
    if wanted is None:
        return classes
    wanted = stored(wanted, "block-pairs")
    sets = stored(sets_of(docs, reps, wanted.select("doc_id").distinct()).select("doc_id", "hashes"), "region-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            found = []
            for key, doc_id, component, own in zip(*(column(batch, c).to_pylist() for c in ("key", "doc_id", "component", "hashes"))):
                if key != now and held:
                    found += _compare_all(held, percent)
                    held = []
                now = key
                held.append((doc_id, component, np.frombuffer(own, dtype="<u8")))
            yield _links(found)
        yield _links(_compare_all(held, percent) if held else [])

    rows = wanted.join(sets, "doc_id").select("key", "doc_id", "component", "hashes")
    more = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(freed(run), "u long, v long"), "left-out")
    if more.isEmpty():
        return classes
    return components(_star_links(classes).union(more))


def _star_links(classes: DataFrame) -> DataFrame:
    return classes.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable), kept.  Sets that share
    ``percent`` of their union are linked."""
    bounded_batches(docs.sparkSession)
    table = stored(signed(docs), "signed")
    own = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = stored(own.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")), "classes")
    pairs = stored(candidates(reps, percent), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(sets_of(docs, reps, ids), "sets")
    near = stored(_confirm_near(sets, percent).union(_same_id(own, reps)), "near-links")
    # stored, so that no task runs two Python workers at a time: an executor keeps them all through later stages
    first = components(near)
    rest = stored(_confirm_pairs(_apart(pairs, first), sets, percent), "far-links")
    classes = _with_left_out(docs, reps, components(_star_links(first).union(rest)), percent)
    # an id may have several rows; all their classes are one component by now
    same = own.select("doc_id", "n_shingles", "digest").join(reps.select("n_shingles", "digest", F.col("doc_id").alias("rep")), ["n_shingles", "digest"])
    found = same.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rows = table.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each group: the smallest id.  Rows without id stay, and
    different texts of that id."""
    gone = near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct().alias("gone")
    left = docs.alias("own").join(gone, F.col("own.doc_id").cast("long") == F.col("gone.doc_id"), "left_anti")
    return left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id IS NULL"))
