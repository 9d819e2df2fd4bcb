import random

import numpy as np
from pyspark.sql import functions as F

from papersift.llm import components as components_of
from papersift.llm import near_dup
from papersift.llm.common import WordHashes
from papersift.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.helpers import awkward, documents, prose


def brute(rows, percent=85):
    """Components by comparing every pair of sets; repeated ids are one node."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.random()}"
    return " ".join(words)


def check(spark, rows):
    want, sets = brute(rows), sorted((i, len(shingles(t))) for i, t in rows if i is not None)
    got = near_dup.near_duplicates(documents(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.component_id) == (r.doc_id, want[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sets


def test_awkward_rows(spark):
    check(spark, awkward() + [(20, "ONE Two"), (21, "one  two\n"), (22, "two one"), (23, None)])


def test_chains_and_large_groups(spark):
    rows, text = [], prose(50, 200)
    for k in range(150):  # a chain: each text is close to the one before, not to the first
        text = edited(text, k, 1)
        rows.append((1000 - k, text))
    base = prose(51, 120)
    rows += [(2000 + k, edited(base, 7000 + k, k % 3)) for k in range(250)]  # a group of near and exact copies
    rows += [(3000 + k, base + " " + prose(9000 + k, 150)) for k in range(60)]  # a shared passage only
    check(spark, rows)


def test_given_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])


def test_one_id_with_two_texts(spark):
    a, b, c = prose(60, 150), prose(61, 150), prose(62, 150)
    rows = [(5, a), (5, b), (6, edited(a, 1, 1)), (7, edited(b, 2, 1)), (3, c), (9, c), (9, edited(b, 3, 1)), (8, edited(c, 4, 1)), (8, None)]
    check(spark, rows)
    docs = documents(spark, rows + [(5, a), (None, a)])
    kept = near_dup.one_of_each(docs.withColumn("_gone", F.lit(1)))
    assert kept.columns == [*docs.columns, "_gone"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (3, c)])


def test_empty(spark):
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


def test_recall_at_the_threshold():
    """Pairs just above 85 %: the forest's and the sketch's miss rates."""
    words, missed, tried = WordHashes(), 0, 0
    for k in range(300):
        a = prose(k, 300)
        b = " ".join(w if i % 50 else f"x{k}" for i, w in enumerate(a.split()))
        x, y = near_dup.shingles(a.encode(), words), near_dup.shingles(b.encode(), words)
        if not near_dup.linked(x, y):
            continue
        (la, sa), (lb, sb) = near_dup.signature(x), near_dup.signature(y)
        depth = max(near_dup._prefix(la[t : t + 20], lb[t : t + 20]) for t in range(0, len(la), 20))
        agree = 256 - (int.from_bytes(sa, "big") ^ int.from_bytes(sb, "big")).bit_count()
        tried += 1
        missed += depth < near_dup.LEAST_DEPTH or agree < near_dup.least_agreement()
    # windows of 5 words make a change cost 5 shingles, so few pairs are close to the threshold
    assert missed == 0 or missed / tried < 0.01


def test_one_of_each_keeps_columns(spark):
    rows = [(1, prose(1, 50)), (2, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (3, prose(2, 50)), (None, prose(1, 50)), (4, None)]
    kept = near_dup.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is not None, i)) == [None, 1, 3, 4]


def test_components(spark):
    r = random.Random(1)
    links = [(k, k + 1) for k in range(0, 300)] + [(1000, 2000 + k) for k in range(500)] + [(r.randrange(5000, 6000), r.randrange(5000, 6000)) for _ in range(700)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long").repartition(6)).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in list(parent) if root(x) != x}


def test_filter_holds_every_id(spark):
    ids = spark.range(5000).select(F.col("id").alias("doc_id"))
    bits = near_dup._filter(ids)
    x = np.array([r[0] for r in ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(near_dup.FILTER_BITS))).collect()])
    assert ((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1).all()


def test_region_just_below_the_threshold(spark):
    """5,000 texts of one template, every pair at 84 %, that hold 40 pairs at 86.5 %; and random edits of a template."""
    base, rows = prose(60, 256), []
    for k in range(5000):  # 252 common shingles and 24 of each text's own
        rows.append((k, base + " " + " ".join(f"t{k}x{i}" for i in range(24))))
    for k in range(40):
        head = rows[k * 61][1].split()[:260]
        rows[4999 - k * 61] = (4999 - k * 61, " ".join(head + [f"s{k}x{i}" for i in range(20)]))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(documents(spark, rows).repartition(5)).collect()}
    assert got == {i: i for i, _ in rows} | {4999 - k * 61: k * 61 for k in range(40)}


def test_whole_regions_are_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 20_000)  # several blocks
    base = prose(61, 220)
    check(spark, [(k, edited(base, 100 + k, 1 + k % 5)) for k in range(700)])
    words = WordHashes()
    sets = [near_dup.shingles(edited(base, 900 + k, 1 + k % 6).encode(), words) for k in range(120)]
    links = [(i, j) for i in range(120) for j in range(i) if near_dup.linked(sets[i], sets[j])]
    want, got = near_dup.Union(), near_dup.Union()
    for a, b in links:
        want.join(a, b)
    for a, b in near_dup._compare_all([(k, k, x) for k, x in enumerate(sets)]):
        assert near_dup.linked(sets[a], sets[b])
        got.join(a, b)
    assert [want.root(k) for k in range(120)] == [got.root(k) for k in range(120)] and len({want.root(k) for k in range(120)}) > 1


def test_pipeline_stage_links_from_80_percent(spark):
    import corpus_pipeline

    rows = []
    for k, own in enumerate((0, 0, 26, 34)):  # 252 common shingles: 252 / (252 + 2 * own) is 83 % and 79 %
        rows += [(2 * k + j, f"{k} " * 5 + prose(70 + k, 251) + " " + " ".join(f"t{k}x{j}x{i}" for i in range(own))) for j in (0, 1)]
    docs = documents(spark, rows)
    sets = {i: shingles(t) for i, t in rows}
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in (4, 6)]
    assert 0.80 <= share[0] < 0.85 and share[1] < 0.80
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 2, 4, 6, 7}
    assert {r.doc_id for r in near_dup.one_of_each(docs).collect()} == {0, 2, 4, 5, 6, 7}


def test_recall_at_80_percent():
    """Pairs from 80 to 85 %: the forest's and the sketch's miss rates."""
    words, missed, tried = WordHashes(), 0, 0
    for k in range(300):
        a = prose(k, 300)
        x, y = (near_dup.shingles(f"{a} {prose(10_000 * j + k, 30 + k % 7)}".encode(), words) for j in (1, 2))
        if not near_dup.linked(x, y, 80) or near_dup.linked(x, y, 85):
            continue
        (la, sa), (lb, sb) = near_dup.signature(x), near_dup.signature(y)
        depth = max(near_dup._prefix(la[t : t + 20], lb[t : t + 20]) for t in range(0, len(la), 20))
        agree = 256 - (int.from_bytes(sa, "big") ^ int.from_bytes(sb, "big")).bit_count()
        tried += 1
        missed += depth < near_dup.LEAST_DEPTH or agree < near_dup.least_agreement(80)
    assert tried > 200 and missed / tried < 0.01


def test_given_table_against_brute_force_at_80_percent(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    ids, union = sorted(sets), near_dup.Union()
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 80).collect()}
    assert got == {i: union.root(i) for i in ids}


def test_links_are_stored_before_their_components(spark, monkeypatch):
    """A task that confirms pairs and joins them into components would run two Python workers at a time."""
    plans, made = [], near_dup.components

    def watched(links):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return made(links)

    monkeypatch.setattr(near_dup, "components", watched)
    rows = [(k, prose(k % 5, 60) + f" end{k}") for k in range(20)]
    assert near_dup.near_duplicates(documents(spark, rows)).where("kept").count() == 5
    assert len(plans) >= 2 and not any("MapInArrow" in p for p in plans)


def test_components_end_without_a_round_that_changes_nothing(spark, monkeypatch):
    """Every round is many tasks that the driver plans and keeps: links that are stars need none, others no last one."""
    made = []
    monkeypatch.setattr(components_of, "stored", lambda df, name, f=components_of.stored: made.append(name) or f(df, name))

    def run(links, parts):
        made.clear()
        rows = spark.createDataFrame(links, "u long, v long").repartition(parts, "u")
        return sorted(map(tuple, components(rows).collect()))

    assert run([(5, 1), (6, 1), (9, 2)], 1) == [(5, 1), (6, 1), (9, 2)] and len(made) == 1
    chain = [(k, k + 1) for k in range(40)]
    assert run(chain, 1) == [(k, 0) for k in range(1, 41)] and len(made) == 1
    assert run(chain, 8) == [(k, 0) for k in range(1, 41)] and len(made) > 1
    assert run([], 2) == [] and len(made) == 1


def test_links_that_are_not_stars_go_on(spark):
    for links in ([(3, 1), (3, 2)], [(3, 2), (2, 1)], [(2, 1), (2, 1)]):
        assert not components_of._stars(spark.createDataFrame(links, "u long, v long"))
    for links in ([], [(3, 1), (2, 1), (9, 8)]):
        assert components_of._stars(spark.createDataFrame(links, "u long, v long"))


def test_known_components_go_through_no_more_rounds(spark, monkeypatch):
    """Without new links the components that are known are stored again and that is all."""
    made = []
    monkeypatch.setattr(components_of, "stored", lambda df, name, f=components_of.stored: made.append(name) or f(df, name))
    rows = [(k, prose(k % 6, 60)) for k in range(12)] + [(20, edited(prose(1, 60), 1, 1))]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute(rows) and made == ["links"] * 2
