"""Token ids in Arrow files of equal-length sequences.

Each file holds two fixed-size-list columns, ``ids`` and ``mask``, in record batches of equal size.
A batch is one contiguous buffer, so sequence i of a file is a zero-copy slice found by arithmetic alone.
Documents follow each other in ascending ``doc_id`` order, across sequences; only the last sequence
of a file is padded (mask false).  A second file beside it says where each document starts.

Defined results: null text is empty (its only id is the end id); repeated or null ``doc_id`` values each keep
their row, nulls first, equal ids ordered by a hash of the text; an empty table writes no file that holds rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column, give_back, scratch, texts_of
from papersift.llm.tokens import END_ID, default_tokenizer, text_encoder

SEQUENCE, BATCH_SEQUENCES = 2048, 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def as_uri(path: str) -> str:
    """The same folder as a URI that pyarrow's file systems take."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return f"file://{path}"
    return path if rest.startswith("//") else f"{scheme}://{rest}"


def file_names(folder: str, number: int) -> tuple[str, str]:
    return f"{folder}/tokens-{number:07d}.arrow", f"{folder}/tokens-{number:07d}.index.arrow"


class _Writer:
    """Writes under a name of its own attempt and renames at the end, so a repeated task replaces a whole file."""

    def __init__(self, folder: str, number: int, attempt: int, length: int, id_type: pa.DataType):
        self.fs, _ = fs.FileSystem.from_uri(folder)
        self.names = [fs.FileSystem.from_uri(p)[1] for p in file_names(folder, number)]
        self.own = [f"{p}.{attempt}.tmp" for p in self.names]
        self.fs.create_dir(self.names[0].rpartition("/")[0], recursive=True)
        self.length, self.id_type = length, id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.streams = [self.fs.open_output_stream(p) for p in self.own]
        self.ids = pa.ipc.new_file(self.streams[0], self.schema)
        self.index = pa.ipc.new_file(self.streams[1], INDEX)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = self.docs = 0
        self.rows: list[tuple] = []

    def _batch(self, flat: np.ndarray, used: int) -> None:
        mask = np.zeros(len(flat), dtype=bool)
        mask[:used] = True
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, type=t), self.length) for x, t in ((flat, self.id_type), (mask, pa.bool_()))]
        self.ids.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))

    def _flush(self, last: bool = False) -> None:
        step = self.length * BATCH_SEQUENCES
        if not last and self.held < step:
            return
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, dtype=self.id_type.to_pandas_dtype())
        full = len(flat) // step * step
        for at in range(0, full, step):
            self._batch(flat[at : at + step], step)
        rest = flat[full:]
        self.waiting, self.held = ([rest], len(rest))
        if last and len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, dtype=flat.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))

    def _index(self) -> None:
        if self.rows:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=INDEX))
            self.rows = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.waiting.append(ids.astype(self.id_type.to_pandas_dtype()))
        self.held += len(ids)
        self.total += len(ids)
        self.docs += 1
        self._flush()
        if len(self.rows) >= 10_000:
            self._index()

    def close(self) -> None:
        self._flush(last=True)
        self._index()
        for w, s in ((self.ids, self.streams[0]), (self.index, self.streams[1])):
            w.close()
            s.close()
        for own, name in zip(self.own, self.names):
            self.fs.move(own, name)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the files (one for each partition of the ``doc_id`` order) and return one row per file:
    file, n_tokens, n_docs, base (ids in all files before it).

    One shuffle: the text, range-partitioned by (doc_id, hash of the text), which also splits a ``doc_id`` that
    many rows share.  ``base`` needs one number from each file on the driver, never anything per document.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer or default_tokenizer()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a partition keeps its number, which names its file, whatever AQE would merge
    rows = texts_of(docs).repartitionByRange(count, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder, out = TaskContext.get(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = text_encoder(path, end_id)
                small = encoder.tokenizer.get_vocab_size() <= 1 << 16
                out = _Writer(folder, context.partitionId(), context.taskAttemptId(), length, pa.uint16() if small else pa.uint32())
            for doc_id, ids in zip(column(batch, "doc_id").to_pylist(), encoder.encode_all(column(batch, "text"))):
                out.add(doc_id, np.frombuffer(ids, dtype="<u4"))
        if out is not None:
            out.close()
            give_back()  # the encoder stays
            yield pa.RecordBatch.from_pydict({"file": [context.partitionId()], "n_tokens": [out.total], "n_docs": [out.docs]})

    made = sorted((r.file, r.n_tokens, r.n_docs) for r in rows.mapInArrow(run, "file long, n_tokens long, n_docs long").collect())
    base, listed = 0, []
    for file, n_tokens, n_docs in made:
        listed.append((file, n_tokens, n_docs, base))
        base += n_tokens
    return spark.createDataFrame(listed, "file long, n_tokens long, n_docs long, base long")


class TokenFile:
    """Random access to one written file; nothing is copied from a local file."""

    def __init__(self, folder: str, number: int):
        names = file_names(folder, number)
        files, name = fs.FileSystem.from_uri(names[0])
        index = fs.FileSystem.from_uri(names[1])[1]
        local = isinstance(files, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else files.open_input_file(name))
        self.index = pa.ipc.open_file(pa.memory_map(index) if local else files.open_input_file(index))

    def batch(self, k: int) -> tuple[np.ndarray, pa.Array]:
        batch = self.reader.get_batch(k)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids and mask of sequence ``i``."""
        batch = self.reader.get_batch(i // BATCH_SEQUENCES)
        k = i % BATCH_SEQUENCES
        return batch.column(0)[k].values.to_numpy(zero_copy_only=True), batch.column(1)[k].values


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32.  A task reads one file, batch by batch."""
    count = max(1, files.count())
    numbered = files.select("file", "base").repartitionByRange(count, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, base in zip(column(batch, "file").to_pylist(), column(batch, "base").to_pylist()):
                yield from _checked(TokenFile(folder, number), base)

    return numbered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checked(file: TokenFile, base: int) -> Iterator[pa.RecordBatch]:
    at, flat, k = 0, np.empty(0, dtype=np.uint16), 0  # flat: the batch that starts at id ``at``
    for part in range(file.index.num_record_batches):
        rows = file.index.get_batch(part)
        sums = []
        for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            crc, pos = 0, start
            while pos < start + n:
                while pos >= at + len(flat):
                    at += len(flat)
                    flat, k = file.batch(k)[0], k + 1
                taken = flat[pos - at : start + n - at]
                crc = zlib.crc32(taken.astype("<u4").tobytes(), crc)
                pos += len(taken)
            sums.append(crc)
        yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "start": pa.array(np.asarray(rows.column(1)) + base), "n_tokens": rows.column(2), "ids_crc32": pa.array(sums, pa.int64())})


def token_index(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` below ``spark.checkpoint.dir`` and read every document back."""
    folder = as_uri(scratch(spark, "token-files"))
    return read(spark, folder, write(docs, folder, tokenizer))
