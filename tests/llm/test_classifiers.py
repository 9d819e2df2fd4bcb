import random
import re
import zlib

import pytest

from papersift.llm import common, quality, toxicity
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, prose

LABELS = "doc_id long, quality int, toxic int"


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(5), [], []
    for i in range(400):
        good, toxic = i % 3 > 0, i % 5 == 0
        words = prose(i % 40, 80).split()
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(8):
                words.insert(r.randrange(len(words)), r.choice(["blockhead", "nitwit", "dunderhead"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), int(toxic)))
    labels += [(3, None, None), (None, 1, 1), (0, labels[0][1], labels[0][2])]
    return documents(spark, rows), spark.createDataFrame(labels, LABELS), {i: (g, t) for i, g, t in labels if g is not None}


def accuracy(rows, truth, k):
    own = [r.predicted == truth[r.doc_id][k] for r in rows if r.held_out and r.doc_id in truth]
    return sum(own) / len(own)


def test_quality_held_out(labelled):
    docs, labels, truth = labelled
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 400 and all(r.held_out == held_out(r.doc_id) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert accuracy(rows, truth, 0) > 0.97


def test_held_out_labels_are_not_learned(labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert (quality.fit(docs, labels) == quality.fit(docs, flipped)).all()
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a[0] == b[0] and (a[2] == b[2]).all()


def test_toxicity_held_out(labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert accuracy(rows, truth, 1) > 0.97
    assert {"blockhead", "nitwit", "dunderhead"} <= set(model[0])


def test_awkward_rows_and_no_labels(spark, labelled):
    docs, labels, _ = labelled
    odd, none = documents(spark, awkward()), documents(spark, [])
    no_labels = labels.limit(0)
    for op in (quality, toxicity):
        model = op.fit(docs, labels)
        assert op.score(odd, model).count() == len(awkward())
        assert op.score(none, model).count() == 0
        assert {r.score for r in op.score(odd, op.fit(odd, no_labels)).collect()} == {0.5}


def test_quality_keep_has_all_columns(spark, labelled):
    docs, labels, _ = labelled
    weights = quality.fit(docs, labels)
    kept, scored = quality.keep(docs, weights), quality.score(docs, weights)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scored.collect() if r.predicted}


def edits(a, b):
    """Letters inserted, left out or replaced, and neighbours swapped, none of them edited again."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def test_automaton_against_edit_distance():
    r = random.Random(3)
    entries = {"".join(r.choice("abc") for _ in range(r.randint(4, 11))): float(k + 1) for k in range(60)}
    lexicon = toxicity.Lexicon(entries, frozenset(), most=200)
    tries = ["".join(r.choice("abc") for _ in range(r.randint(3, 12))) for _ in range(2000)]
    for e in entries:  # near the entries: one to three edits
        for n in (1, 2, 3):
            word = list(e)
            for _ in range(n):
                k, kind = r.randrange(len(word)), r.randrange(4)
                word[k : k + 2] = {0: [], 1: [word[k], "z", *word[k + 1 : k + 2]], 2: ["0", *word[k + 1 : k + 2]], 3: word[k : k + 2][::-1]}[kind] or word[k + 1 : k + 2]
            tries.append("".join(word))
    for word in tries:
        near = [-w for e, w in entries.items() if len(e) >= 5 and edits(e, word) <= (1 if len(e) < 9 else 2)]
        assert lexicon.weight(word) == (entries[word] if word in entries else min(near, default=0.0) if len(word) >= 4 else 0.0), word


def test_misspelled_with_digits_symbols_and_swaps():
    scorer = toxicity.Scorer({"idiot": 4.0, "stupid": 3.0, "trash": 3.5, "blockhead": 5.0}, frozenset(["strash"]))
    for word in ("idi0t", "st*pid", "tr@sh", "idoit", "\"idi0t!\"", "(st*pid),", "bl0ckhe@d", "blcokhaed", "stupi-d"):
        assert scorer.measures(f"what a {word} this is".encode())[1] > 0, word
    for word in ("id10t", "st**id", "strash", "t-r-a-s-h", "2024-01-01", "a" * 5000, "-" * 5000):
        assert scorer.measures(f"what a {word} this is".encode())[:2] == [0.0, 0.0], word
    assert scorer.measures(b"what an idiot!") [0] > 0


def plain_measures(text, weights):
    """Every word against every entry, and every window read word by word."""
    import math

    runs, sums = text.split(), [0.0, 0.0]
    quotes = "\"“”«»„‘’"
    tokens = [re.findall(r"[^\W\d_]+|[\"“”«»„‘’]", x.lower()) for x in runs]
    for k, run in enumerate(runs):
        forms = {re.sub(r"^\W+", "", re.sub(r"\W+$", "", run.lower())), *re.findall(r"[^\W\d_]+", run.lower())}
        found = []
        for form in forms:
            near = [-w for e, w in weights.items() if len(e) >= 5 and edits(e, form) <= (1 if len(e) < 9 else 2)]
            found.append(weights[form] if form in weights else min(near, default=0.0) if len(form) >= 4 else 0.0)
        weight = max(found, key=lambda w: (abs(w), w), default=0.0)
        if not weight:
            continue
        before, after = sum(tokens[max(0, k - 8) : k], []), sum(tokens[k + 1 : k + 9], [])
        own = tokens[k]
        opened = sum(t in quotes for t in before) + (own[:1] != [] and own[0] in quotes)
        closed = sum(t in quotes for t in after) + (own[-1:] != [] and own[-1] in quotes)
        said = any(t in toxicity.REPORTING for t in before[-3:])
        sums[weight < 0] += abs(weight) * (0.3 if said or (opened % 2 and closed) else 1.0)
    n = max(1, len(runs))
    return [math.log1p(x) for x in (*sums, 100 * sums[0] / n, 100 * sums[1] / n)]


def test_measures_against_plain_scorer():
    r = random.Random(9)
    weights = {"idiot": 4.0, "stupid": 3.0, "trash": 3.5, "blockhead": 5.0, "dunderhead": 4.5, "nit": 2.75}
    pool = [*weights, "idi0t", "stupd", "tarsh", "blokched", "said", "wrote", "“so", "then”", "\"", "and", "the", "house,", "(stupid)", "nits"]
    scorer = toxicity.Scorer(weights, frozenset(), most=40)
    for _ in range(300):
        text = " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))
        got, want = scorer.measures(text.encode()), plain_measures(text, weights)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), text


def test_quotation_counts_less():
    scorer = toxicity.Scorer({"blockhead": 5.0}, frozenset())
    abuse = scorer.measures(b"you are a blockhead and you know it well")
    quotation = scorer.measures('they wrote "you are a blockhead" and left the room'.encode())
    misspelled = scorer.measures(b"you are a blokhead and you know it well")
    assert abuse[0] > quotation[0] > 0 and misspelled[1] > 0 and misspelled[0] == 0


def test_given_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    assert accuracy(quality.score(docs, quality.fit(docs, labels)).collect(), truth, 0) >= 0.8


def test_shape_of_long_runs():
    import time

    began = time.time()
    assert common.word_parts("a" + "-" * 1_000_000 + "b") == ("", "a" + "-" * 1_000_000 + "b", "")
    assert common.word_parts("-" * 1_000_000) == ("-" * 1_000_000, "", "") and common.word_parts("(a.b)!?") == ("(", "a.b", ")!?")
    assert time.time() - began < 5
