"""Token ids of whole texts with a public byte-level BPE file.

``TextEncoder.encode(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.
It uses that white space separates tokens.  Arrow splits a batch of texts at ASCII white space and numbers the distinct runs,
then the distinct pieces of those; a piece whose ids are not remembered goes to the tokenizer's model, many at a time,
and numpy lays the ids out in the order of the texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from papersift.llm.common import kept

#: End-of-document id that the token queries append.
END_ID = 2
#: Pieces of a generation that an encoder remembers; a piece takes about 0.2 kB.
REMEMBERED = 250_000
#: Bytes of texts (a longer text: alone) and of new pieces that are taken together, and items that are laid out at once.
TEXT_BYTES, PIECE_BYTES, ITEMS = 8 << 20, 1 << 18, 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The split pattern of the tokenizer file, written out for printable Latin-1 runs with a space before each.
_PLAIN = re.compile("[ !-~¡-¬®-ÿ]*")
_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ a-zªµºß-öø-ÿ0-9²³¹¼-¾]+| "
)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level BPE vocabulary."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


def _parts(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of neighbours whose sizes add up to ``most`` at most, or of one that is larger."""
    first = k = held = 0
    for k, size in enumerate(sizes, 1):
        if held and held + size > most:
            yield first, k - 1
            first, held = k - 1, 0
        held += size
    if k > first:
        yield first, k


class Remembered:
    """Ids that ``make`` gave, in two generations of bounded size: a full one becomes the old one, and what is met again
    moves to the new one, so what is frequent is never made twice."""

    def __init__(self, most: int, make: Callable[[list[str]], list[bytes]]):
        self.most, self.make = most, make
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, keys: list[str]) -> list[bytes]:
        """Ids of each of the distinct ``keys``."""
        found = list(map(self.new.get, keys))
        where = [k for k, ids in enumerate(found) if ids is None]
        missing = [keys[k] for k in where]
        values = list(map(self.old.get, missing))
        unknown = [k for k, ids in enumerate(values) if ids is None]
        for k, ids in zip(unknown, self.make([missing[k] for k in unknown])):
            values[k] = ids
        for k, ids in zip(where, values):
            found[k] = ids
        if len(self.new) + len(missing) > self.most:
            self.old, self.new = self.new, {}
        self.new.update(zip(missing[: self.most], values))
        return found


class Laid:
    """Ids of numbered items on end: item k has ``counts[k]`` of ``flat``, from ``starts[k]`` on."""

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat, self.counts, self.starts = flat, counts, np.cumsum(counts) - counts

    @classmethod
    def of(cls, values: list[bytes]) -> Laid:
        return cls(np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int64, len(values)) // 4)

    def in_order(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the items ``which`` on end, and how many stand before each item and after the last."""
        made, ends = [self.flat[:0]], [np.zeros(1, np.int64)]
        for at in range(0, len(which), ITEMS):
            own = which[at : at + ITEMS]
            n = self.counts[own]
            upto = np.cumsum(n)
            made.append(self.flat[np.repeat(self.starts[own] - upto + n, n) + np.arange(upto[-1])])
            ends.append(upto + ends[-1][-1])
        return np.concatenate(made), np.concatenate(ends)


class TextEncoder:
    """Ids as little-endian unsigned 32-bit bytes.

    Ids of at most two times ``most_pieces`` pieces are remembered; ``most_runs`` distinct runs of a batch are cut into pieces at once."""

    def __init__(self, path: str, end_id: int | None = END_ID, most_runs: int = REMEMBERED, most_pieces: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for many pieces at once: a space parts them and gives an id of its own
        self.spaced = Tokenizer(self.tokenizer.model)
        self.spaced.add_tokens([AddedToken(" ", normalized=False)])
        self.space = self.spaced.token_to_id(" ")
        self.characters = str.maketrans({b: c for b, c in _byte_characters().items() if b != 0x20})
        self.pieces = Remembered(most_pieces, self._new_pieces)
        self.most_runs = most_runs
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        made = []
        for first, end in _parts(map(len, pieces), PIECE_BYTES):
            said = " ".join(pieces[first:end])
            if not said.isascii():
                said = said.encode().decode("latin-1").translate(self.characters)
            ids = np.array(self.spaced.encode_batch_fast([said], add_special_tokens=False)[0].ids, dtype="<u4")
            gaps, data = 4 * np.flatnonzero(ids == self.space), ids.tobytes()
            made += [data[a:b] for a, b in zip([0, *(gaps + 4).tolist()], [*gaps.tolist(), len(data)])]
        return made

    def _plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(s in text for s in self.specials)

    def _plain_runs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs in ``text``, where a space stands before each run, and how many each run has."""
        coded = pa.array(_PIECES.findall(text.lower()), pa.large_string()).dictionary_encode()
        pieces, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids, before = Laid.of([b"", *self.pieces.of(pieces[1:])]).in_order(which)  # the first piece is a space
        return ids, np.diff(before[np.append(np.flatnonzero(which == 0), len(which))])

    def _runs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same with a space between two runs; one that is not plain goes through the whole tokenizer."""
        if self._plain(text):
            return self._plain_runs(" " + text)
        runs = text.split(" ")
        plain = np.array([self._plain(run) for run in runs])
        ids, n = self._plain_runs("".join(f" {run}" for run, p in zip(runs, plain) if p))
        rest = [np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, dtype="<u4") for run, p in zip(runs, plain) if not p]
        laid = Laid(np.concatenate([ids, *rest]), np.concatenate([n, np.fromiter(map(len, rest), np.int64, len(rest))]))
        place = np.argsort(np.argsort(~plain, kind="stable"))  # the plain runs are laid first
        return laid.in_order(place)[0], laid.counts[place]

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string column, then the end id."""
        texts = texts.cast(pa.large_string()).fill_null("")
        for a, b in _parts(pc.binary_length(texts).to_pylist(), TEXT_BYTES):
            yield from self._together(texts.slice(a, b - a))

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        runs, made = coded.dictionary, [(np.empty(0, "<u4"), np.empty(0, np.int64))]
        for at in range(0, len(runs), self.most_runs):
            part = runs.slice(at, self.most_runs)
            joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(part)], part), pa.scalar(" ", part.type))[0]
            made.append(self._runs(str(joined.as_buffer(), "utf-8", "replace")))
        ids, before = Laid(*map(np.concatenate, zip(*made))).in_order(coded.indices.to_numpy())
        bounds = before[np.asarray(words.offsets) - words.offsets[0].as_py()].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield ids[a:b].tobytes() + self.end

    def encode(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text, then the end id."""
        return next(self.encode_all(pa.array([text], pa.binary()).view(pa.string())))


def text_encoder(path: str, end_id: int | None = END_ID, remembered: int = REMEMBERED) -> TextEncoder:
    """One encoder for each Python worker, so that the ids it remembers serve all tasks of the worker."""
    return kept(("encoder", path, end_id, remembered), lambda: TextEncoder(path, end_id, remembered, remembered))
