import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from papersift.llm import exact_dup, queries, spelling, whitening
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, prose

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near = collections.defaultdict(set)
    without = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            without[w[:k] + w[k + 1 :]].add(w)
    for shorter, longer in without.items():
        if shorter in n:
            for w in longer:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in without.values():  # two words that are equal without one letter each: replaced, or further apart
        for a in group:
            for b in group:
                if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1:
                    near[a].add(b)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def edited(r, word):
    k, kind = r.randrange(len(word) + 1), r.randrange(3)
    letter = r.choice("abcéÿ÷")
    return word[:k] + letter + word[k + (kind == 1) :] if kind < 2 else word[:k] + word[k + 1 :]


def test_variants_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "straßeße", "x" * 3000, "x" * 2999 + "y", "x" * 3001]
    words = base + [edited(r, w) for w in base for _ in range(4)] + [edited(r, edited(r, w)) for w in base for _ in range(2)]
    rows = awkward() + [(100 + k, " ".join(w.title() if r.random() < 0.2 else w for w in r.choices(words, k=40))) for k in range(60)]
    rows += [(300, "commonword " * 1000), (301, "comonword " * 40 + "comonwort " * 2 + "commonwerd " * 5), (None, "comonword, comonword"), (400, "Αbcdefgh1bcdefgh Abcdefg_bcdefgh")]
    assert got_variants(spelling.variants(documents(spark, rows))) == brute_variants(rows)


def test_variants_of_the_given_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got_variants(queries.op11_spelling(spark, SF_SMALL)) == brute_variants(rows)


def test_variants_of_empty_tables(spark):
    assert spelling.variants(documents(spark, [])).count() == 0
    assert spelling.variants(documents(spark, [(1, None), (2, "onceonly")])).count() == 0


def test_chain_of_forms(spark):
    rows = [(1, "abcdefgh " * 2000), (2, "abcdefg " * 150), (3, "abcdefx " * 12), (4, "abcdxfx " * 2)]
    want = brute_variants(rows)
    assert got_variants(spelling.variants(documents(spark, rows))) == want


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append((i is None, i or 0))
    out = []
    for (i, _), t in zip(rows, norm):
        none, least = min(groups[t])
        out.append((i, None if none else least, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def exact_rows():
    r = random.Random(3)
    texts = [prose(k, 12) for k in range(30)]
    rows = [(1000 - k, r.choice(texts).replace(" ", r.choice([" ", "\n", " \t\x0b"]))) for k in range(400)]
    return rows + awkward() + [(None, texts[0]), (-5, texts[1]), (2000, "a b"), (2001, "a b"), (2002, "a  b"), (2003, " a b"), (2004, "a b ")]


@pytest.mark.parametrize("slots", [None, 1, 100])
def test_exact_duplicates_against_brute_force(spark, slots, monkeypatch):
    if slots:
        own = exact_dup.merged
        monkeypatch.setattr(exact_dup, "merged", lambda e: own(e, slots))
        monkeypatch.setattr(exact_dup, "RUN_ROWS", 16)
    rows = exact_rows()
    got = exact_dup.exact_duplicates(documents(spark, rows).repartition(5)).collect()
    want, groups = brute_exact(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_of_an_empty_table_and_plan(spark):
    empty = documents(spark, [])
    assert exact_dup.exact_duplicates(empty).count() == 0
    for df in (exact_dup.runs(empty), exact_dup.merged(exact_dup.runs(empty)), exact_dup.exact_duplicates(empty)):
        assert not re.search("Python|Pandas|Arrow|ExternalRDD", df._jdf.queryExecution().executedPlan().toString())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, x string, n double")


def held(rows):
    import math

    whole = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in whole]


def check_whitening(got, rows, components=16):
    own = held(rows)
    fit = sorted({tuple(x) for _, x in own})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for x in fit])
    _, values, axes = np.linalg.svd(centred)
    values, axes = np.pad(values, (0, d - len(values))) ** 2 / n, axes.T
    count = min(components, int((values > 1e-26 * values[0]).sum()))
    assert len(got) == len(own) * count and {r.component for r in got} == set(range(1, count + 1))
    want = collections.Counter((i, sum((n * v - s) ** 2 for v, s in zip(x, sums))) for i, x in own for _ in range(count))
    assert collections.Counter((r.vec_id, r.deviation) for r in got) == want
    for k in range(count):
        part = [r for r in got if r.component == k + 1]
        assert all(r.n == n and r.identity_error <= 1e-4 and abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9 for r in part)
        apart = min(abs(values[k] - v) for j, v in enumerate(values) if j != k) if d > 1 else 1
        if apart > 1e-6 * values[0]:
            at = collections.defaultdict(list)
            for i, x in own:
                at[i].append(float((np.array([(n * v - s) / n for v, s in zip(x, sums)]) @ axes[:, k]) / values[k] ** 0.5))
            ours = collections.defaultdict(list)
            for r in part:
                ours[r.vec_id].append(r.whitened)
            best = min(max(np.abs(np.sort(np.array(ours[i]) * sign) - np.sort(at[i])).max() for i in at) for sign in (1, -1))
            assert best < 1e-7


def random_rows(n, d, seed=0):
    g = np.random.default_rng(seed)
    mixed = g.normal(size=(n, d)) @ np.diag(2.0 ** -np.arange(d)[:d].clip(0, 6)) @ g.normal(size=(d, d))
    return [(k, v.tolist(), None, "x", 1.0) for k, v in enumerate(mixed)]


def test_whitening_against_numpy(spark):
    rows = random_rows(300, 20) + random_rows(300, 20)[:40] + [(None, [0.5] * 20, 1, None, None), (7, None, 1, "", 0.0), (8, [None] * 20, 1, "", 0.0), (9, [float("nan")] + [0.0] * 19, 1, "", 0.0), (10, [float("-inf")] + [0.0] * 19, 1, "", 0.0)]
    check_whitening(whitening.whitened(vectors(spark, rows).repartition(4)).collect(), rows)


def test_whitening_without_full_rank(spark):
    rows = [(i, [v[0], v[1], v[0], 3.0, -v[1], v[2] * 1e-3], None, None, None) for i, v, *_ in random_rows(200, 3)]
    check_whitening(whitening.whitened(vectors(spark, rows)).collect(), rows)
    few = random_rows(4, 20, 2)
    check_whitening(whitening.whitened(vectors(spark, few)).collect(), few)


def test_whitening_of_large_scales(spark):
    rows = [(i, [v[0] * 1e4, v[1], v[2] * 1e-1 + v[0] * 1e4, v[3]], None, None, None) for i, v, *_ in random_rows(200, 4)]
    check_whitening(whitening.whitened(vectors(spark, rows)).collect(), rows)


def test_whitening_edges(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0, "", 0.0)] * 3)).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [], 0, "", 0.0)])).count() == 0
    with pytest.raises(ValueError):
        whitening.whitened(vectors(spark, [(1, [1.0], 0, "", 0.0), (2, [1.0, 2.0], 0, "", 0.0)]))
    with pytest.raises(OverflowError):
        whitening.Centre(2, np.array([0])).deviations(np.array([[2**40]]))


def test_whitening_of_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitening(queries.op13_whitening(spark, SF_SMALL).collect(), rows)
