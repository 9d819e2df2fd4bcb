import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.operators import enrich, ratings
from papersift.sinks.files import write_ratings_csv
from papersift.sources.bibliography import read_export

# A bibliography export: byte-order mark,
# quoted fields with doubled quotes and line breaks; the id comes from Extra,
# then Url, then Publication Title.
EXPORT = (
    "﻿\"Key\",\"Item Type\",\"Title\",\"Publication Title\",\"Url\",\"Extra\"\n"
    "\"K1\",\"journalArticle\",\"A \"\"quoted\"\" title\",\"arXiv preprint arXiv:1604.07316\",\"\",\"\"\n"
    "\"K2\",\"preprint\",\"Two\",\"\",\"http://arxiv.org/abs/2302.05541\",\"\"\n"
    "\"K3\",\"preprint\",\"Three\nlines\",\"\",\"\",\"arXiv:2302.05542 [cs.CL]\"\n"
    "\"K4\",\"preprint\",\"Four\",\"arXiv:1111.11111\",\"\",\"arXiv:2302.05543\"\n"
    "\"K5\",\"preprint\",\"Five\",\"\",\"https://arxiv.org/abs/2401.14196v2\",\"no id here\"\n"
    "\"K6\",\"book\",\"Six\",\"\",\"\",\"\"\n"
)


def test_ids_from_bibliography(spark, tmp_dir):
    path = os.path.join(tmp_dir, "export.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write(EXPORT)
    df = read_export(spark, path)
    assert df.columns[0] == "Key"  # byte-order mark removed
    ids = sorted(r.id for r in ratings.extract_ids(df).collect())
    assert ids == ["1604.07316", "2302.05541", "2302.05542", "2302.05543", "2401.14196"]
    out = os.path.join(tmp_dir, "prefs")
    write_ratings_csv(ratings.ratings_from_ids(ratings.extract_ids(df)), out)
    back = spark.read.option("header", True).csv(out).orderBy("id").collect()
    assert [r.preference for r in back] == ["like"] * 5


def test_enrich_failures_go_to_side_table(spark):
    wanted = spark.createDataFrame([("1", "One. Two."), ("2", "no stop"), ("3", "Cached one.")], "id string, abstract string")
    cached = spark.createDataFrame([("3", "from cache")], "id string, summary string")

    def fn(row):
        if "." not in row["abstract"]:
            raise ValueError("no sentence")
        return {"summary": row["abstract"].split(".")[0] + "."}

    fields = T.StructType([T.StructField("summary", T.StringType())])
    res, failed = enrich.enrich(wanted, cached, fn, fields, {"model": "m"}, "2025-01-01T00:00:00+00:00")
    got = {r.id: r.summary for r in res.collect()}
    assert got == {"1": "One.", "3": "from cache"}
    bad = failed.collect()
    assert [(r.id, r.error) for r in bad] == [("2", "ValueError: no sentence")]


def test_parse_digest_strips_fence_and_flags_missing(spark):
    good = '```json\n{"institution":["A"],"reasoning_step":"r","problem_background":"p","method":"m",' \
           '"experiment":"e","one_sentence_summary":"o","slug":"s","keywords":["k"],"further_thoughts":"f"}\n```'
    bad = '{"institution":["A"]}'
    df = spark.createDataFrame([("1", good), ("2", bad)], "id string, raw string")
    out = {r.id: r for r in enrich.parse_digest(df, "raw").collect()}
    assert out["1"].error is None and out["1"].slug == "s"
    assert out["2"].error.startswith("missing fields: ")
    assert F  # keep import


def test_code_fence_only_when_both_ends(spark):
    from papersift.functions.text import strip_code_fence

    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("```json\n{\"a\": 1}",), ("{}",)], "t string")
    got = [r.x for r in df.select(strip_code_fence("t").alias("x")).collect()]
    assert got == ['{"a": 1}', "```json\n{\"a\": 1}", "{}"]


def test_enrich_calls_the_function_once_per_row(spark, tmp_dir):
    import os
    import uuid

    log = os.path.join(tmp_dir, "calls")
    os.makedirs(log)
    wanted = spark.createDataFrame([(str(i), "x.") for i in range(20)], "id string, abstract string")
    cached = spark.createDataFrame([], "id string, summary string")

    def fn(row):
        open(os.path.join(log, f"{row['id']}-{uuid.uuid4().hex}"), "w").close()
        if row["id"] == "3":
            raise ValueError("boom")
        return {"summary": "s"}

    fields = T.StructType([T.StructField("summary", T.StringType())])
    res, failed = enrich.enrich(wanted, cached, fn, fields, {}, "t")
    assert res.count() == 19 and failed.count() == 1
    res.collect(), failed.collect()
    assert len(os.listdir(log)) == 20


def overlap(log):
    """The most calls that were running at one time."""
    import os

    marks = []
    for name in os.listdir(log):
        began, ended = map(float, name.split("_")[:2])
        marks += [(began, 1), (ended, -1)]
    most = now = 0
    for _, step in sorted(marks):
        now += step
        most = max(most, now)
    return most, len(marks) // 2


def sleeper(log):
    def fn(row):
        import os
        import time
        import uuid

        began = time.time()
        time.sleep(0.02)
        if int(row["id"]) % 10 == 3:
            raise ValueError("boom")
        open(os.path.join(log, f"{began}_{time.time()}_{uuid.uuid4().hex}"), "w").close()
        return {"summary": "s" + row["id"]}

    return fn


def test_calls_in_flight_are_bounded(spark, tmp_dir):
    wanted = spark.range(200).selectExpr("CAST(id AS STRING) AS id")
    fields = T.StructType([T.StructField("summary", T.StringType())])
    tasks, in_flight = enrich.shares(8, 2)
    assert (tasks, in_flight) == (2, 4) and enrich.shares(3, 8) == (3, 1) and enrich.shares(20, 8) == (8, 2)
    out = enrich.apply_per_row(wanted, sleeper(tmp_dir), fields, num_partitions=tasks, in_flight=in_flight).collect()
    assert sorted((int(r.id), r.summary) for r in out if r.error is None) == [(k, f"s{k}") for k in range(200) if k % 10 != 3]
    assert sorted(int(r.id) for r in out if r.error == "ValueError: boom") == list(range(3, 200, 10))
    most, calls = overlap(tmp_dir)
    assert calls == 180 and 4 < most <= 8


def test_window_keeps_order_and_reads_no_further():
    import time

    taken = []

    def items():
        for k in range(40):
            taken.append(k)
            yield k

    def call(k):
        time.sleep(0.01 * (5 - k % 5))
        return k

    results = enrich.in_window(items(), call, 5)
    for k in range(10):
        assert next(results) == k
        assert len(taken) <= k + 6  # back-pressure: the window and the item that waits for a place
    results.close()
    assert len(taken) <= 15
    assert list(enrich.in_window(range(30), call, 4)) == list(range(30)) and list(enrich.in_window([], call, 4)) == []


def test_repeated_wanted_ids_are_called_once(spark, tmp_dir):
    wanted = spark.createDataFrame([("1",), ("1",), ("2",)], "id string")
    cached = spark.createDataFrame([("2", "cached")], "id string, summary string")
    fields = T.StructType([T.StructField("summary", T.StringType())])
    res, failed = enrich.enrich(wanted, cached, sleeper(tmp_dir), fields, {}, "t")
    assert sorted((r.id, r.summary) for r in res.collect()) == [("1", "s1"), ("2", "cached")]
    assert failed.count() == 0 and overlap(tmp_dir)[1] == 1


def test_route_digests(spark):
    fields = T.StructType([T.StructField("slug", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))])
    texts = [("1", '{"slug":"a","keywords":["k"]}'), ("2", '```json\n{"slug":"b","keywords":[]}\n```'), ("3", '{"slug":"c"}'),
             ("4", '{"slug":"d","keywords":'), ("5", None), ("6", " \n"), ("7", "no json"), ("8", '{"slug":null,"keywords":null}'), ("9", "null")]
    df = spark.createDataFrame(texts, "id string, raw string")
    records, errors = enrich.route_digests(df, "raw", schema=fields)
    assert sorted((r.id, r.slug, r.keywords) for r in records.collect()) == [("1", "a", ["k"]), ("2", "b", [])]
    got = {r.id: (r.kind, r.fields, r.text) for r in errors.collect()}
    assert got == {
        "3": (enrich.MISSING, ["keywords"], None), "4": (enrich.NOT_JSON, None, texts[3][1]), "5": (enrich.NO_TEXT, None, None),
        "6": (enrich.NO_TEXT, None, None), "7": (enrich.NOT_JSON, None, "no json"), "8": (enrich.MISSING, ["slug", "keywords"], None),
        "9": (enrich.NOT_JSON, None, "null")}
    some, _ = enrich.route_digests(df, "raw", schema=fields, required=["slug"])
    assert sorted(r.id for r in some.collect()) == ["1", "2", "3"]


def test_rows_reach_the_function_in_bounded_batches(spark):
    """A worker holds few rows as Python objects, and no batch is larger than the bound, however many rows a task has."""
    import pandas as pd

    from papersift.session import BATCH_ROWS

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    fields = T.StructType([T.StructField("n", T.LongType())])
    out = enrich.apply_per_row(spark.range(3000).selectExpr("CAST(id AS STRING) AS id", "id AS n"), lambda row: {"n": row["n"] + 1}, fields, num_partitions=1)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert sorted((int(r.id), r.n, r.error) for r in out.collect()) == [(k, k + 1, None) for k in range(3000)]
    batch = pd.DataFrame({"id": ["a", None, "c"] * 100, "n": range(300)})
    assert list(enrich.records([batch, batch[:0]])) == batch.to_dict("records")
