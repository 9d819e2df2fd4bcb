"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>role<|text|>`` + text + ``<|end|>``.  Any control string inside a role or text, the template's
own or another common template's, gets a backslash after its first byte, and a backslash is doubled, so
formatting is reversible and no text can forge a turn.

A batch of turns is one buffer: the lengths of all segments are computed, their cumulative sums are the offsets, escape
positions shift the bytes behind them, and numpy scatters fixed parts and contents into one preallocated
buffer that Arrow then holds as a string column.  The loss mask is two byte offsets for each turn (an assistant's text).

Turns are formatted row by row; only reading a whole conversation back, whose digests run over all its turns in
order, sorts by conversation, and streams it in bounded memory whatever its length.

Defined results: null text or role is empty; turns follow (turn, formatted turn), nulls first, so ties and repeated rows have a
fixed order; rows without a conversation id form one conversation with a null id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import bounded_batches, column

TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
ESCAPE = b"\\"
#: Control strings of common chat templates; ``<|`` starts all of this template's own.
CONTROLS = (b"<|", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>", b"<start_of_turn>", b"<end_of_turn>")
LEARNED = "assistant"
_CONTROL = re.compile(b"|".join(map(re.escape, CONTROLS)) + b"|" + re.escape(ESCAPE))
_ESCAPED = re.compile(re.escape(ESCAPE) + b"(.)", re.S)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column whose nulls are empty."""
    values = values.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if len(values) else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _escaped(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same strings with an escape byte before each backslash and after the first byte of each control string."""
    raw = data.tobytes()
    found = [(m.start(), data[m.start()] != ESCAPE[0]) for m in _CONTROL.finditer(raw)]
    if not found:
        return data, ends
    starts, inside = (np.array(x) for x in zip(*found))
    text = np.searchsorted(ends, starts, side="right") - 1
    last = starts + np.array([len(m.group()) for m in _CONTROL.finditer(raw)]) <= ends[text + 1]
    if not last.all():  # a control string that two neighbouring texts only make together: search them one by one
        parts = [_escaped_one(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    before = starts + inside  # an escape byte goes before this one
    shift = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(shift, before, 1)
    shift = np.cumsum(shift)
    out = np.full(len(data) + len(before), ESCAPE[0], dtype=np.uint8)
    out[np.arange(len(data)) + shift[:-1]] = data
    return out, ends + np.searchsorted(before, ends, side="left")


def _escaped_one(text: bytes) -> bytes:
    return _CONTROL.sub(lambda m: ESCAPE + m[0] if m[0] == ESCAPE else m[0][:1] + ESCAPE + m[0][1:], text)


def unescaped(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", text)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one string column, and the byte offsets of each text inside its turn."""
    role, role_ends = _escaped(*_flat(roles))
    text, text_ends = _escaped(*_flat(texts))
    n = len(role_ends) - 1
    segments = np.empty((n, 5), dtype=np.int64)  # lengths of: turn mark, role, text mark, text, end mark
    segments[:] = len(TURN), 0, len(TEXT), 0, len(END)
    segments[:, 1], segments[:, 3] = np.diff(role_ends), np.diff(text_ends)
    starts = np.concatenate([[0], np.cumsum(segments.ravel())])
    out = np.empty(starts[-1], dtype=np.uint8)
    at = starts[:-1].reshape(n, 5)
    for k, mark in ((0, TURN), (2, TEXT), (4, END)):
        out[at[:, k, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)
    for k, data, ends in ((1, role, role_ends), (3, text, text_ends)):
        out[np.arange(len(data)) + np.repeat(at[:, k] - ends[:-1], np.diff(ends))] = data
    turns = np.concatenate([at[:, 0], starts[-1:]])
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(turns.astype(np.int64)), pa.py_buffer(out)])
    return made.cast(pa.string()), at[:, 3] - at[:, 0], at[:, 4] - at[:, 0]


FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, and the bytes of it under the loss mask (equal ends: none)."""
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, start, end = assemble(column(batch, "role"), column(batch, "text"))
            learned = np.array([r == LEARNED for r in column(batch, "role").to_pylist()], dtype=bool)
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), column(batch, "turn"), made, pa.array(start), pa.array(np.where(learned, end, start))], names=["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    return rows.mapInArrow(run, FORMATTED)


def parse(formatted: bytes) -> tuple[bytes, bytes]:
    """(role, text) of one formatted turn."""
    role, mark, text = formatted[len(TURN) : -len(END)].partition(TEXT)
    if not mark or formatted[: len(TURN)] != TURN or formatted[-len(END) :] != END:
        raise ValueError("not a formatted turn")
    return unescaped(role), unescaped(text)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int) -> None:
        own = formatted.encode()
        role, text = parse(own)
        self.turns.update(b"%b\n%b\n" % (role, text))
        learned = unescaped(own[start:end])
        self.loss.update(learned)
        self.loss_chars += len(learned.decode())
        self.chars += len(formatted)
        self.n += 1

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted turns alone.

    A conversation's turns meet in one task, sorted, and stream through its digests; none is held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, text, start, end in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Digest(conv_id)
                now.add(text, start, end)
            yield _rows(done)
            done = []
        yield _rows([now.row()] if now else [])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(run, DIGEST)
