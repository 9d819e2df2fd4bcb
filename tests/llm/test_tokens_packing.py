import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papersift.llm import packing, token_files, tokens
from papersift.llm.tokens import END_ID, TextEncoder, default_tokenizer
from tests.llm.helpers import awkward, documents, prose

PLAIN = Tokenizer.from_file(default_tokenizer())
FAST = TextEncoder(default_tokenizer(), None, most_runs=200, most_pieces=100)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB'sret 09é́ß½ \x1c\x85İΣ<|endoftext|>\n", max_size=60))
def test_encoder_equals_the_library(text):
    assert np.frombuffer(FAST.encode(text.encode("utf-8", "replace")), "<u4").tolist() == plain_ids(text.encode("utf-8", "replace").decode())


def test_encoder_on_awkward_rows():
    for _, text in awkward():
        assert np.frombuffer(FAST.encode((text or "").encode()), "<u4").tolist() == plain_ids(text)


def test_encoder_takes_new_words_together():
    """Python's own calls don't grow with the words that are new."""
    text, calls = " ".join(f"{w}{k}." for k, w in enumerate(prose(11, 5000).split())), [0]
    encoder = TextEncoder(default_tokenizer(), None)

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids = encoder.encode(text.encode())
    finally:
        sys.setprofile(None)
    assert np.frombuffer(ids, "<u4").tolist() == plain_ids(text) and calls[0] < 1000


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_encoder_cuts_batches(monkeypatch, kind):
    """Texts, runs, pieces and words in parts of a few; some parts have runs for the whole tokenizer, some have none or only those."""
    monkeypatch.setattr(tokens, "TEXT_BYTES", 60)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 10)
    monkeypatch.setattr(tokens, "ITEMS", 3)
    texts = [t for _, t in awkward()[:-1]] + ["中 文 Ω", "Ünï ünï the The, the.", "", "a <|endoftext|>b", "  two  gaps\n"] * 3
    encoder = TextEncoder(default_tokenizer(), END_ID, most_runs=4, most_pieces=5)
    column = pa.array(["left out", *texts], kind).slice(1)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(column)] == [plain_ids(t) + [END_ID] for t in texts]
        assert len(encoder.pieces.new) <= 5 and len(encoder.pieces.old) <= 5
    assert list(encoder.encode_all(pa.array([], kind))) == []


def expected(rows):
    return {(i, zlib.crc32(np.array(plain_ids(t) + [END_ID], "<u4").tobytes())) for i, t in rows}


def check_pieces(rows, pieces, capacity):
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(plain_ids(t) + [END_ID], "<u4"))
    by_sequence, covered = defaultdict(list), defaultdict(int)
    for p in pieces:
        own = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
        assert own and p.length > 0
        by_sequence[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id] += p.length
    assert covered == {i: sum(map(len, x)) for i, x in ids.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


@pytest.mark.parametrize("partitions,shard", [(1, 1 << 20), (5, 3000)])
def test_packing_awkward_rows(spark, partitions, shard):
    rows = awkward()
    docs = documents(spark, rows).repartition(partitions)
    pieces = packing.pack(docs, capacity=512, shard_tokens=shard, with_ids=True)
    sequences = check_pieces(rows, pieces.collect(), 512)
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) == -(-total // 512)  # only one sequence is not full
    made = packing.sequences(pieces).collect()
    assert sum(len(r.input_ids) // 4 for r in made) == total
    assert all(len(r.input_ids) == 4 * r.n_tokens and r.cost > 0 for r in made)


def test_packing_balances_cost():
    lengths = [400, 300, 300, 200, 200, 200, 100, 100, 100, 100]
    placed, rest = packing.assign(lengths, 500, keep_rest=False)
    cost = defaultdict(float)
    for _, _, n, k, _ in placed:
        cost[k] += packing.LINEAR * n + packing.QUADRATIC * n * n
    assert not rest and len(cost) == 4 and max(cost.values()) / min(cost.values()) < 1.1
    assert [p[0] for p in placed][0] == 0


def test_packing_empty(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_token_files_awkward_rows(spark):
    rows = awkward()
    got = token_files.token_index(spark, documents(spark, rows).repartition(4)).collect()
    assert {(r.doc_id, r.ids_crc32) for r in got} == expected(rows) and len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_token_files_random_access(spark, tmp_path):
    rows = [(i, t) for i, t in awkward() if i is not None]
    folder = token_files.as_uri(str(tmp_path / "files"))
    files = token_files.write(documents(spark, rows), folder, length=64, partitions=3).collect()
    stream = np.concatenate([np.array(plain_ids(t) + [END_ID]) for _, t in sorted(rows, key=lambda r: r[0])])
    for f in files:
        opened = token_files.TokenFile(folder, f.file)
        for i in range(0, -(-f.n_tokens // 64), 7):
            ids, mask = opened.sequence(i)
            want = stream[f.base + 64 * i : f.base + min(64 * i + 64, f.n_tokens)]
            assert len(ids) == 64 and ids[: len(want)].tolist() == want.tolist()
            assert mask.to_pylist() == [k < len(want) for k in range(64)]


def test_token_files_empty(spark):
    assert token_files.token_index(spark, documents(spark, [])).count() == 0
