"""Helpers that the operators share: scratch tables, Arrow batches, words."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.session import bounded_batches, ensure_checkpoint_dir  # noqa: F401 - the operators take the first from here

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table below ``spark.checkpoint.dir`` and read it back.

    The table cuts the lineage: a lost executor makes its readers read files again, nothing is recomputed.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` (long) and ``text`` (null: empty); other columns and their names don't matter."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def held_out(key: str = "doc_id"):
    """The rows whose labels no model may learn: crc32(key as text) mod 4 is 2.  A null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8_values(values: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one text at a time, without making Python strings."""
    values = values.cast(pa.large_string()) if not pa.types.is_large_string(values.type) else values
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = memoryview(values.buffers()[2] or b"")
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield bytes(data[a:b])


_WORD_CHAR = re.compile(r"\w")


def word_parts(run: str) -> tuple[str, str, str]:
    """What stands before the first word character, from it to the last one, and after."""
    first = _WORD_CHAR.search(run)
    if not first:
        return run, "", ""
    end = len(run)
    while not _WORD_CHAR.match(run, end - 1):
        end -= 1
    return run[: first.start()], run[first.start() : end], run[end:]


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_KEPT: dict = {}


def kept(key: tuple, make):
    """The table that ``make`` gives, kept for all later tasks of this Python worker until another operator asks for
    its own; so a worker that runs several operators in turn holds one such table at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` whose worker gives its memory back to the system when a task ends, as it may idle through a later stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _KEPT.clear()
        give_back()

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = word_hashes[:count].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + count]
    return mixed(out)
