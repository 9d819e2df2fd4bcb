import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import types as T

from papersift.sinks import versioned
from papersift.sinks.archive import upsert
from papersift.sources.archive import read_archive

S3 = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "summary")])


def frame(spark, rows):
    return spark.createDataFrame(rows, S3)


def archived(spark, path, version=None):
    return sorted((r.id, r.title, r.month) for r in versioned.read(spark, path, S3, version).collect())


def test_upserts_replace_whole_rows_and_keep_versions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    versioned.create(spark, path)  # again: nothing happens
    assert read_archive(spark, path).count() == 0 and versioned.versions(spark, path) == [0]
    assert upsert(frame(spark, [("2505.1", "a", "x"), ("0704.1", "b", "y")]), path, ["title"]) == ["0704", "2505"]
    assert upsert(frame(spark, [("2505.1", "new", None), ("2505.2", "c", "z")]), path, ["title"]) == ["2505"]
    assert archived(spark, path) == [("0704.1", "b", "0704"), ("2505.1", "new", "2505"), ("2505.2", "c", "2505")]
    assert archived(spark, path, 1) == [("0704.1", "b", "0704"), ("2505.1", "a", "2505")]  # an old version stays readable
    assert sorted(r.id for r in read_archive(spark, path).collect()) == ["0704.1", "2505.1", "2505.2"]  # by the manifest's schema
    assert upsert(frame(spark, [("2505.9", None, " ")]), path, ["title"]) == []  # nothing with content: no new version
    assert versioned.versions(spark, path) == [0, 1, 2]


def test_two_writers_of_one_month_lose_nothing(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    upsert(frame(spark, [("2505.0", "first", "s")]), path, ["title"])
    batches = [frame(spark, [(f"2505.{w}{k}", f"w{w}", "s") for k in range(5)] + [("2505.0", f"by {w}", "s")]) for w in range(1, 5)]
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(upsert, b, path, ["title"]) for b in batches]:
            assert done.result() == ["2505"]
    got = archived(spark, path)
    assert len(got) == 21 and {i for i, _, _ in got} == {"2505.0"} | {f"2505.{w}{k}" for w in range(1, 5) for k in range(5)}
    assert versioned.versions(spark, path) == list(range(6))
    assert dict((i, t) for i, t, _ in got)["2505.0"] in {f"by {w}" for w in range(1, 5)}


def test_lost_race_over_other_months_publishes_the_same_files(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    own, writes = versioned._publish, []

    def late(spark_, file, text):
        if len(writes) == 0 and json.loads(text)["months"].keys() == {"2505"}:
            writes.append(1)
            upsert(frame(spark, [("2401.1", "other", "s")]), path, ["title"])  # another writer is first
        own(spark_, file, text)

    monkeypatch.setattr(versioned, "_publish", late)
    upsert(frame(spark, [("2505.1", "a", "s")]), path, ["title"])
    assert archived(spark, path) == [("2401.1", "other", "2401"), ("2505.1", "a", "2505")]
    assert len(os.listdir(os.path.join(path, "data"))) == 2  # nothing was written twice


def test_lost_race_over_the_same_month_merges_again(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    own, writes = versioned._publish, []

    def late(spark_, file, text):
        if not writes:
            writes.append(1)
            upsert(frame(spark, [("2505.2", "other", "s")]), path, ["title"])
        own(spark_, file, text)

    monkeypatch.setattr(versioned, "_publish", late)
    upsert(frame(spark, [("2505.1", "a", "s")]), path, ["title"])
    assert archived(spark, path) == [("2505.1", "a", "2505"), ("2505.2", "other", "2505")]


def test_readers_see_old_or_new(spark, tmp_dir):
    """While batches of one title replace each other in two months, every read has one title only."""
    path, rounds = os.path.join(tmp_dir, "a"), 5
    ids = [f"{m}.{k}" for m in ("2505", "2506") for k in range(4)]
    versioned.create(spark, path)
    upsert(frame(spark, [(i, "t0", "s") for i in ids]), path, ["title"])
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append([t for _, t, _ in archived(spark, path)])

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for k in range(1, rounds):
            upsert(frame(spark, [(i, f"t{k}", "s") for i in ids]), path, ["title"])
    finally:
        stop.set()
        reader.join()
    assert seen and all(len(t) == len(ids) and len(set(t)) == 1 for t in seen)


def test_a_version_is_published_once(spark, tmp_dir):
    file = os.path.join(tmp_dir, "_manifest", "x.json")
    versioned._publish(spark, file, "one")
    with pytest.raises(versioned.Conflict):
        versioned._publish(spark, file, "two")
    assert open(file).read() == "one" and os.listdir(os.path.dirname(file)) == ["x.json"]


def test_clean_and_plain_archives(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    for k in range(4):
        upsert(frame(spark, [("2505.1", f"t{k}", "s"), (f"24{k:02}.1", "x", "s")]), path, ["title"])
    assert versioned.clean(spark, path, keep=2) == 0  # each older commit still holds a month of its own
    upsert(frame(spark, [(f"24{k:02}.1", "y", "s") for k in range(4)]), path, ["title"])
    before = archived(spark, path)
    assert versioned.clean(spark, path, keep=1) == 3
    assert archived(spark, path) == before and len(versioned.versions(spark, path)) == 1
    plain = os.path.join(tmp_dir, "plain")
    upsert(frame(spark, [("2505.1", "a", "s")]), plain, ["title"])
    assert not versioned.is_versioned(spark, plain)
    with pytest.raises(ValueError, match="plain"):
        versioned.create(spark, plain)


def test_narrower_batch_keeps_stored_fields(spark, tmp_dir):
    path = os.path.join(tmp_dir, "a")
    versioned.create(spark, path)
    upsert(frame(spark, [("2505.1", "old", "s")]), path, ["title"])
    narrow = T.StructType(S3.fields[:2])
    upsert(spark.createDataFrame([("2505.2", "new")], narrow), path, ["title"])
    got = {r["id"]: r["summary"] for r in read_archive(spark, path).collect()}
    assert got == {"2505.1": "s", "2505.2": None}


def test_batch_is_computed_once(spark, tmp_dir):
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    counted = counted.asNondeterministic()
    path = os.path.join(tmp_dir, "plain")
    upsert(frame(spark, [("2505.0", "old", "s")]), path, ["title"])
    batch = frame(spark, [(f"2505.{k}", "t", "s") for k in range(50)]).withColumn("summary", counted("summary"))
    upsert(batch, path, ["title"])
    assert calls.value == 50
