import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from papersift.llm import decontaminate, licenses, quality_rules
from tests.llm.helpers import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    inside = {x for places in windows.values() if len(places) > 1 for k in places for x in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def rule_rows():
    r = random.Random(2)
    rows = awkward() + [(100 + k, " ".join(r.choice("ab") for _ in range(r.randint(1, 60)))) for k in range(40)]
    return rows + [(200, "a\nb\na\n \n\nb\na "), (201, "# $ % & | < > *"), (202, "x " * 19), (203, " ".join(prose(9, 25).split() * 2))]


def test_measures_against_brute_force(spark):
    rows = rule_rows()
    got = quality_rules.apply_policy(quality_rules.ledger(documents(spark, rows))).collect()
    want = sorted(((i is not None, i or 0), *brute_measures(t)) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        base = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == base and (not base or not r.kept)


def test_policies_and_ablation(spark):
    rows = quality_rules.ledger(documents(spark, rule_rows())).persist()
    ledger = [r.failed for r in rows.collect()]
    for version, mask in quality_rules.POLICIES.items():
        assert quality_rules.apply_policy(rows, version).where("kept").count() == sum(not f & mask for f in ledger)
        for r in quality_rules.ablation(rows, version).collect():
            bit = quality_rules.BIT[r.rule]
            assert r.failing == sum(bool(f & bit) for f in ledger) and r.failing_alone == sum(f & mask == bit for f in ledger)


def test_rules_keep_and_empty(spark):
    docs = documents(spark, rule_rows())
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality_rules.apply_policy(quality_rules.ledger(docs)).where("kept").count()
    assert quality_rules.ledger(documents(spark, [])).count() == 0


def test_rules_plan_is_native(spark):
    plan = quality_rules.ledger(documents(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_a_common_subsequence(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 25))] for _ in range(2))
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.patience(a, a) == [(k, k) for k in range(len(a))]


def test_license_scan(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-notice"]
    changed = " ".join("word" if k % 12 == 5 else w for k, w in enumerate(mit.split()))
    rows = awkward() + [(30, prose(5, 500) + "\n" + mit.upper() + "\n" + prose(6, 500)), (31, prose(7, 40) + " " + changed), (32, gpl + " x " + gpl), (33, " ".join(mit.split()[:60])), (34, " ".join(reversed(mit.split()))), (35, prose(8, 30_000) + " " + gpl)]
    got = {(r.doc_id, r.license): r for r in licenses.scan(documents(spark, rows)).collect()}
    assert set(got) == {(30, "MIT"), (31, "MIT"), (32, "GPL-3.0-notice"), (35, "GPL-3.0-notice")}
    r = got[(30, "MIT")]
    assert (r.coverage, r.first_word, r.end_word) == (1.0, 500, 500 + len(licenses.words_of(mit)))
    assert 0.8 <= got[(31, "MIT")].coverage < 1 and got[(35, "GPL-3.0-notice")].first_word == 30_000
    assert licenses.scan(documents(spark, [])).count() == 0


ITEMS = "item_id long, text string, doc_id long"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def test_leaks(spark):
    r = random.Random(8)
    items = {k: prose(500 + k, r.randint(15, 60)) for k in range(30)} | {40: prose(600, 150)}
    rows = awkward() + [(100 + k, prose(k, 300)) for k in range(60)]
    for k in range(30):  # whole; case and punctuation changed; a few words changed
        rows.append((1000 + k, f"{prose(k, 77)} {items[k]} {prose(k + 1, 90)}"))
        rows.append((2000 + k, f"{prose(k, 50)} {', '.join(items[k].split()).upper()}!"))
        words = items[k].split()
        words[3 :: 9] = ["other"] * len(words[3::9])
        rows.append((3000 + k, " ".join(words) + " " + prose(k + 5, 60)))
    rows += [(4000, prose(1, 40) + " " + items[40]), (4001, items[0].split()[0])]
    benchmark = spark.createDataFrame([(k, t, None) for k, t in items.items()] + [(70, None, None), (71, "", 1), (None, "x", None), (0, items[0], None)], ITEMS)
    docs = documents(spark, rows).repartition(3)
    got = decontaminate.matches(docs, benchmark).collect()
    want = {(base + k, k) for base in (1000, 2000, 3000) for k in range(30)} | {(4000, 40)}
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    kept = decontaminate.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted(i or -1 for i, _ in rows if i not in {d for d, _ in want})


def test_leaks_of_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, prose(1, 20), None)], ITEMS)
    assert decontaminate.matches(documents(spark, []), benchmark).count() == 0
    assert decontaminate.matches(documents(spark, awkward()), benchmark.limit(0)).count() == 0
    assert decontaminate.without_leaks(documents(spark, awkward()), benchmark.limit(0)).count() == len(awkward())


def test_confirmation_against_plain_lcs():
    import numpy as np

    r = random.Random(6)
    for _ in range(200):
        segment = [r.choice("abcdefghij") for _ in range(r.randint(3, 40))]
        vocabulary = decontaminate.Vocabulary(sorted(set(segment)))
        model = decontaminate.Model([(1, segment)], np.ones(len(vocabulary.columns)), 10, vocabulary)
        text = [r.choice("abcdefghij") for _ in range(60)]
        common, answer = model.confirm(0, np.array([vocabulary.columns.get(w, -1) for w in text]))
        if answer >= decontaminate.ANSWER:
            assert round(common * len(segment)) == lcs(segment, text)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "RANK", 8)
    items = [(k, prose(700 + k, 30), None) for k in range(40)]
    docs = documents(spark, [(k, prose(k, 100) + " " + items[k % 40][1]) for k in range(80)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {(k, k % 40) for k in range(80)}
    assert docs.where(F.col("doc_id") < 0).count() == decontaminate.without_leaks(docs, spark.createDataFrame(items, ITEMS)).count()


def test_short_items_in_text_dense_in_benchmark_words(spark):
    """Lists of short items, and short items among words of other items: every item whose words stand in a row is found."""
    pool, r = prose(800, 400).split(), random.Random(8)
    pool = sorted(set(pool))
    items = [(k, " ".join(r.sample(pool, r.randint(4, 8)))) for k in range(200)]
    texts = [" ".join(t for _, t in r.sample(items, 40)) for _ in range(20)]  # lists
    for k in range(60):  # one item inside other benchmark words
        words = [r.choice(pool) for _ in range(200)]
        at = r.randrange(180)
        texts.append(" ".join(words[:at] + [items[k][1]] + words[at:]))
    for k in range(60, 100):  # one word of it changed
        words, own = [r.choice(pool) for _ in range(120)], items[k][1].split()
        own[len(own) // 2] = "changed"
        texts.append(" ".join(words[:50] + own + words[50:]))
    rows = [(k, t) for k, t in enumerate(texts)]
    want = {(i, k) for i, t in rows for k, item in items if f" {item} " in f" {t} "}
    docs, benchmark = documents(spark, rows + [(1000 + k, prose(900 + k, 100)) for k in range(20)]), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, benchmark).collect()}
    assert want <= got
    for i, k in got - want:  # only what the longest common subsequence of some window confirms
        own, words, half = items[k][1].split(), texts[i].split(), -(-len(items[k][1].split()) // 2)
        wide = any(lcs(own, words[a : a + 96]) >= 0.6 * len(own) for a in range(0, len(words), 32))
        assert wide
    assert len([1 for i, k in got if 80 <= i < 120 and k == i - 20 and len(items[k][1].split()) >= 5]) >= 30  # the edited copies
    assert {x.doc_id for x in decontaminate.without_leaks(docs, benchmark).collect()} >= set(range(1000, 1020))


def test_items_of_ordinary_words(spark):
    """Items of a few words, or of few different ones, are no leak in a text that merely holds them."""
    rows = [(k, prose(k, 80) + " in the zebra of the the the house and a cat " + prose(50 + k, 40)) for k in range(20)]
    rows += [(100, "In"), (101, "the ZEBRA, the!"), (102, "in the zebra"), (103, "the the the the the the the the the the"), (104, None), (105, "")]
    items = [(1, "in", None), (2, "the the", None), (3, "the the zebra", None), (4, "the zebra the", None), (5, "the the the the the the the the the the", None)]
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, benchmark).collect()} == {(100, 1), (101, 4), (103, 5)}
    assert {x.doc_id for x in decontaminate.without_leaks(docs, benchmark).collect()} == {i for i, _ in rows} - {100, 101, 103}


@pytest.fixture(scope="module")
def latent(spark):
    """40 items, 300 clean documents and the model fitted on them, with its vocabulary."""
    items = {k: prose(700 + k, 15 + k) for k in range(40)}
    docs = documents(spark, [(k, prose(k, 200)) for k in range(300)])
    group, _, vocabulary = next(decontaminate.models(docs, spark.createDataFrame([(k, t, None) for k, t in items.items()], ITEMS)))
    assert len(group) == 1
    return group[0], vocabulary, items


def found(latent, texts):
    model, vocabulary, _ = latent
    return [{model.items[s] for s, *_ in hits} for hits in model.search([vocabulary.of(t.encode()) for t in texts])]


def test_long_texts_in_slices(latent, monkeypatch):
    """A passage is found wherever a slice of a long text ends."""
    texts, want = [], []
    for k in range(40):
        words = prose(k, 1500).split()
        inside = [(k + n) % 40 for n in range(3)]
        for item, at in zip(inside, (200 + 11 * k, 505, 760 + k)):
            words[at:at] = latent[2][item].split()
        texts.append(" ".join(words))
        want.append(set(inside))
    whole = found(latent, texts)
    monkeypatch.setattr(decontaminate, "TOGETHER", 256)
    assert found(latent, texts) == whole == want


def test_the_latent_space_holds_the_segments(latent):
    model = latent[0]
    for s, w in enumerate(model.words):
        c, x = model.row(w)
        assert abs(np.linalg.norm(model.latent[s]) - 1) < 1e-3 and model.length[s] > 0.9 * np.sqrt(model.mass[s]), s


def reworded(kind, words, r):
    if kind == "moved":
        a = len(words) // 3
        return words[a : 2 * a] + words[2 * a :] + words[:a]
    if kind == "shuffled":
        parts = [words[k : k + 5] for k in range(0, len(words), 5)]
        r.shuffle(parts)
        return sum(parts, [])
    if kind == "reversed":
        return [w for k in range(0, len(words), 3) for w in words[k : k + 3][::-1]]
    return [w if r.random() > 0.25 else "otherwise" for w in reworded("moved", words, r)]


@pytest.mark.parametrize("kind", ["moved", "shuffled", "reversed", "replaced"])
def test_paraphrases(latent, kind):
    """Items with their parts in another order, or words replaced, are found; documents of other words are not."""
    r = random.Random(kind)
    texts = [" ".join(prose(5000 + k, 60).split() + reworded(kind, t.split(), r) + prose(6000 + k, 60).split()) for k, t in latent[2].items()]
    got = found(latent, texts)
    assert sum(k in hits for k, hits in enumerate(got)) >= 0.9 * len(texts)
    assert all(hits <= {k} for k, hits in enumerate(got))
    # words of many items, mixed, are no paraphrase of any
    pool = " ".join(latent[2].values()).split()
    assert not any(found(latent, [" ".join(r.choice(pool) for _ in range(300)) for _ in range(40)]))


def test_the_cosine_decides(latent, monkeypatch):
    texts = [prose(k, 50) + " " + t + " " + prose(k + 1, 50) for k, t in latent[2].items()]
    assert found(latent, texts) == [{k} for k in latent[2]]
    monkeypatch.setattr(decontaminate, "COSINE", 2.0)
    assert not any(found(latent, texts))


def test_candidates_against_every_window(latent):
    """Copies and edited copies in text dense in benchmark words: all that plain LCS over all windows confirms."""
    model, vocabulary, items = latent
    r = random.Random(31)
    pool = " ".join(items.values()).split()
    for k in range(40):
        own = items[k].split()
        for _ in range(r.randint(0, len(own) // 5)):
            own[r.randrange(len(own))] = r.choice(pool)
        words = [r.choice(pool) for _ in range(60)] + own + [r.choice(pool) for _ in range(60)]
        hits = found(latent, [" ".join(words)])[0]
        for item, t in items.items():
            best = max(lcs(t.split(), words[a : a + len(t.split()) + 4]) for a in range(0, len(words), 2)) / len(t.split())
            assert best < 0.75 or item in hits, (k, item, best)


def test_scan_against_alignment_of_every_window():
    """The scanner, which skips windows, against aligning each template with all its windows."""
    r = random.Random(21)
    names = ["MIT-notice", "ISC", "CC-BY-4.0", "Unlicense"]
    templates = {n: licenses.TEMPLATES[n] for n in names}
    scanner = licenses.Scanner(templates, 0.8)
    for _ in range(60):
        words = prose(r.randrange(10**6), r.randint(0, 60)).split()
        for n in r.sample(names, r.randint(0, 3)):
            own = templates[n].split()
            for _ in range(r.randint(0, max(1, len(own) // 6))):
                own[r.randrange(len(own))] = r.choice(["the", "software", "xyz"])
            at = r.randint(0, len(words))
            words[at:at] = own
        text = " ".join(words)
        plain = licenses.words_of(text)
        want = {}
        for n in names:
            own = licenses.words_of(templates[n])
            best = max((len(licenses.patience(own, plain[k : k + 2 * len(own)])) for k in range(0, max(1, len(plain)), len(own))), default=0)
            if best >= 0.8 * len(own):
                want[n] = best / len(own)
        assert {n: c for n, c, _, _ in scanner.scan(text)} == want


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_is_found(name):
    text = prose(1, 50) + " " + licenses.TEMPLATES[name].upper().replace(" ", "\n * ") + " " + prose(2, 50)
    found = {n: c for n, c, _, _ in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)}
    assert found[name] == 1.0


def test_the_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    """The sums of products are those of every passage of every text, long texts in slices, whatever the partitions."""
    monkeypatch.setattr(decontaminate, "FITTED_TOGETHER", 2)
    items = [(k, prose(700 + k, 20)) for k in range(10)]
    texts = [prose(k, 30 + 40 * (k % 12)) + " " + items[k % 10][1] for k in range(60)] + [None, "", "unknown"]
    segments = [(k, t.split()) for k, t in items]
    vocabulary = decontaminate.Vocabulary(sorted({w for _, words in segments for w in words}))
    rows = decontaminate.coded(decontaminate.texts_of(documents(spark, list(enumerate(texts))).repartition(5)), vocabulary)
    model = decontaminate.Model(segments, *decontaminate.document_frequencies(rows, vocabulary), vocabulary)
    got = decontaminate.word_products(rows, model, vocabulary.kind)
    want, n = np.zeros(got.shape), 0
    for text in texts:
        words = model.local(vocabulary.of((text or "").encode()))
        for k in range(0, len(words), 96):
            c, w = model.row(words[k : k + 96][words[k : k + 96] >= 0])
            want[np.ix_(c, c)] += np.outer(w, w)
            n += len(c) > 0
    assert n > 80 and np.allclose(got, want, atol=1e-4) and abs(np.trace(got) - n) < 0.01


def test_a_task_holds_the_upper_half_of_the_products():
    words = [f"w{k}" for k in range(40)]
    vocabulary = decontaminate.Vocabulary(sorted(words))
    model = decontaminate.Model([(1, words)], np.arange(1, 41), 10_000, vocabulary)
    out, want, keys = np.zeros(40 * 41 // 2, dtype=np.float32), np.zeros((40, 40)), []
    for k in range(12):
        c = np.arange(k, 40, k + 1)
        x = model.row(c)[1]
        want[np.ix_(c, c)] += np.outer(x, x)
        keys.append(k * 40 + c)
    model.add_products(out, np.concatenate(keys))
    assert np.allclose(out, want[np.triu_indices(40)], atol=1e-5)


def test_blocks_have_few_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "COLUMNS", 50)
    segments = [[f"w{k}-{n}" for n in range(20)] for k in range(9)]
    blocks = decontaminate._blocks(segments)
    assert all(len(set().union(*segments[k::blocks])) <= 50 for k in range(blocks)) and blocks < 9
    assert decontaminate._blocks([[f"w{n}" for n in range(64)]]) == 1


def test_the_driver_holds_half_of_the_products(spark):
    """It holds less than the whole matrix of the words' products."""
    words = [f"w{k}" for k in range(2400)]
    items = [(k, words[60 * k : 60 * k + 60]) for k in range(40)]
    vocabulary = decontaminate.Vocabulary(sorted(words))
    rows = decontaminate.coded(decontaminate.texts_of(documents(spark, [(k, " ".join(own + words[k::40])) for k, own in items])), vocabulary)
    model = decontaminate.Model(items, *decontaminate.document_frequencies(rows, vocabulary), vocabulary)
    tracemalloc.start()
    products = decontaminate.word_products(rows, model, vocabulary.kind)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert products.shape == (2400, 2400) and most < 0.8 * 4 * 2400**2


def test_products_in_strips(monkeypatch):
    monkeypatch.setattr(decontaminate, "STRIP", 7)
    r = np.random.default_rng(1)
    for size in (1, 7, 30):
        want = r.random((size, size)).astype(np.float32)
        want = np.triu(want) + np.triu(want, 1).T
        got = decontaminate.Symmetric(size)
        for k in range(size):
            got.put(k, want[k, k:])
        c = np.arange(0, size, 3)
        w = r.random(len(c))
        got.add_outer(c, w, 2.5)
        want[np.ix_(c, c)] += 2.5 * np.outer(w, w)
        other = r.random((size, 4))
        assert np.array_equal(np.asarray(got), want) and np.isclose(got.trace(), np.trace(want))
        assert np.allclose(got.times(other), want @ other, atol=1e-4)
