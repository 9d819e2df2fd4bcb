"""Cost-balanced packing of documents into fixed-length sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention stays inside a document).
Documents in descending order go to the lowest-cost sequence that has room for them; one that fits
nowhere whole is cut: it fills the lowest-cost sequence that has any room, and its rest goes back in line.

Scale: each task packs its own rows, ``shard_tokens`` at a time, and fills every sequence but leaves
less than one sequence over.  Only these leftovers are shuffled, and packed once more.  No text, and
no token but theirs, is shuffled, and nothing is collected.

Defined results: null text is empty (one piece, the end id); repeated or null ``doc_id`` values are packed
row by row; an empty table gives no pieces; very long documents are cut at the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, give_back, stored, texts_of
from papersift.llm.tokens import END_ID, REMEMBERED, default_tokenizer, text_encoder

CAPACITY, SHARD_TOKENS = 4096, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_SECOND = 1 << 62  # sequence ids of the second pass


def assign(lengths: list[int], capacity: int, keep_rest: bool, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple], list[tuple]]:
    """Placed pieces (item, start, length, sequence, offset) and the rest (item, start, length).

    ``keep_rest`` fills whole sequences only; less than ``capacity`` tokens remain.
    """
    total = sum(lengths)
    count = total // capacity if keep_rest else -(-total // capacity)
    line = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    if not count:
        return [], [(i, start, -n) for n, i, start in line]
    heapq.heapify(line)
    cost, room = np.zeros(count), np.full(count, capacity, dtype=np.int64)
    placed, rest = [], []
    while line:
        n, item, start = heapq.heappop(line)
        n = -n
        fits = room >= n
        if not fits.any():
            fits = room > 0
            if not fits.any():
                rest.append((item, start, n))
                continue
        k = int(np.where(fits, cost, np.inf).argmin())
        taken = min(n, int(room[k]))
        placed.append((item, start, taken, k, capacity - int(room[k])))
        room[k] -= taken
        cost[k] += linear * taken + quadratic * taken * taken
        if taken < n:
            heapq.heappush(line, (taken - n, item, start + taken))
    return placed, rest


class _Shard:
    """Pieces that wait in one task: (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, capacity: int, first_sequence: int, with_ids: bool):
        self.capacity, self.next, self.with_ids = capacity, first_sequence, with_ids
        self.waiting: list[tuple] = []
        self.tokens = 0

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: bytes) -> None:
        self.waiting.append((doc_id, start, doc_tokens, ids))
        self.tokens += len(ids) // 4

    def pack(self, keep_rest: bool) -> pa.RecordBatch:
        placed, rest = assign([len(w[3]) // 4 for w in self.waiting], self.capacity, keep_rest)
        rows = []
        for item, at, n, sequence, offset in placed:
            doc_id, start, doc_tokens, ids = self.waiting[item]
            own = ids[4 * at : 4 * (at + n)]
            rows.append((doc_id, start + at, n, zlib.crc32(own), doc_tokens, self.next + sequence, offset, own if self.with_ids else None))
        kept = []
        for item, at, n in rest:
            doc_id, start, doc_tokens, ids = self.waiting[item]
            kept.append((doc_id, start + at, doc_tokens, ids[4 * at : 4 * (at + n)]))
        self.next += 1 + max((p[3] for p in placed), default=-1)
        self.waiting, self.tokens = kept, sum(len(k[3]) // 4 for k in kept)
        return _batch(rows)

    def leftovers(self) -> pa.RecordBatch:
        return _batch([(d, start, len(ids) // 4, zlib.crc32(ids), n, None, None, ids) for d, start, n, ids in self.waiting])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless ``with_ids``).

    ``remembered`` trades a worker's memory for encoding the same pieces again, see ``TextEncoder``."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = text_encoder(path, end_id, remembered), _Shard(capacity, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoder.encode_all(column(batch, "text"))):
                step = 4 * shard_tokens
                for at in range(0, len(ids), step):  # a document longer than a shard goes through several
                    shard.add(doc_id, at // 4, len(ids) // 4, ids[at : at + step])
                    if shard.tokens >= shard_tokens:
                        yield shard.pack(keep_rest=True)
        yield shard.pack(keep_rest=True)
        yield shard.leftovers()
        give_back()  # the encoder stays

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(capacity, _SECOND | TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for row in batch.to_pylist():
                shard.add(row["doc_id"], row["start"], row["doc_tokens"], row["ids"])
                if shard.tokens >= shard_tokens:
                    yield shard.pack(keep_rest=True)
        yield shard.pack(keep_rest=False)

    pieces = stored(texts_of(docs).mapInArrow(first, PIECES), "packed-shards")
    rest = pieces.where("sequence_id IS NULL")
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, tokens // shard_tokens)
    spread = rest.repartition(shards, F.xxhash64("doc_id", "start", "ids_crc32") if shards > 1 else F.lit(0))
    again = spread.sortWithinPartitions("doc_id", "start", "ids_crc32").mapInArrow(second, PIECES)
    return pieces.where("sequence_id IS NOT NULL").unionByName(again)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence from pieces that carry ids: input_ids, the start of each piece in them, and the cost.

    A group holds at most ``capacity`` tokens.
    """
    n = F.col("length").cast("double")
    rows = pieces.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("parts"),
        F.sum("length").alias("n_tokens"),
        F.sum(n * LINEAR + n * n * QUADRATIC).alias("cost"),
    )
    return rows.select(
        "sequence_id", "n_tokens", "cost",
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"),
        F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("input_ids"),
    )
