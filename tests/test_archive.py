import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.sinks.archive import upsert
from papersift.sources.archive import read_archive

S3 = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
                   T.StructField("summary", T.StringType())])


def _month_rows(path, month):
    out = []
    folder = os.path.join(path, f"month={month}")
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                out += [json.loads(line) for line in f if line.strip()]
    return out


def test_ids_only_one_month_in_id_order(spark, tmp_dir):
    df = spark.createDataFrame([("2505.67890",), ("2505.12345",)], "id string")
    assert upsert(df, tmp_dir) == ["2505"]
    assert [r["id"] for r in _month_rows(tmp_dir, "2505")] == ["2505.12345", "2505.67890"]


def test_empty_frame_without_columns_is_noop(spark, tmp_dir):
    df = spark.createDataFrame([], T.StructType([]))
    assert upsert(df, tmp_dir + "/a") == []


def test_missing_id_raises(spark, tmp_dir):
    df = spark.createDataFrame([("x",)], "title string")
    with pytest.raises(ValueError, match="DataFrame missing 'id' column."):
        upsert(df, tmp_dir)


def test_rows_split_by_month(spark, tmp_dir):
    ids = ["2505.12345", "2505.67890", "2401.54321", "2401.98765"]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert upsert(df, tmp_dir) == ["2401", "2505"]
    assert [r["id"] for r in _month_rows(tmp_dir, "2401")] == ["2401.54321", "2401.98765"]


def test_blank_rows_are_dropped(spark, tmp_dir):
    rows = [("2505.00001", "T", "S"), ("2505.00002", None, None), ("2505.00003", "", " "),
            ("2505.00004", "   ", ""), ("2505.00005", "　", None)]
    df = spark.createDataFrame(rows, S3)
    upsert(df, tmp_dir, order_by=["title"])
    assert [r["id"] for r in _month_rows(tmp_dir, "2505")] == ["2505.00001"]


def test_non_ascii_round_trip_and_nulls_written(spark, tmp_dir):
    df = spark.createDataFrame([("2505.11111", "大型语言模型", None)], S3)
    upsert(df, tmp_dir, order_by=["title"])
    rec = _month_rows(tmp_dir, "2505")[0]
    assert rec["title"] == "大型语言模型"
    assert "summary" in rec and rec["summary"] is None


def test_overwrite_same_id_and_upsert_twice_equals_once(spark, tmp_dir):
    first = spark.createDataFrame([("2505.00001", "old", "a"), ("2505.00002", "keep", "b"),
                                   ("2401.00001", "other month", "c")], S3)
    upsert(first, tmp_dir, order_by=["title"], schema=S3)
    second = spark.createDataFrame([("2505.00001", "new", None)], S3)
    assert upsert(second, tmp_dir, order_by=["title"], schema=S3) == ["2505"]
    once = sorted(tuple(r) for r in read_archive(spark, tmp_dir, S3).collect())
    upsert(second, tmp_dir, order_by=["title"], schema=S3)
    twice = sorted(tuple(r) for r in read_archive(spark, tmp_dir, S3).collect())
    assert once == twice
    got = {r[0]: r for r in once}
    assert got["2505.00001"][1] == "new" and got["2505.00001"][2] is None  # whole row replaced
    assert got["2505.00002"][1] == "keep"
    assert got["2401.00001"][1] == "other month"


def test_last_row_wins_within_a_batch(spark, tmp_dir):
    df = spark.createDataFrame([("2505.00001", "a", "2025-01-01"), ("2505.00001", "b", "2025-02-01")],
                               "id string, title string, summary_time string")
    upsert(df, tmp_dir)
    assert [r["title"] for r in _month_rows(tmp_dir, "2505")] == ["b"]


def test_month_keeps_leading_zero(spark, tmp_dir):
    df = spark.createDataFrame([("0704.0001", "t", "s")], S3)
    upsert(df, tmp_dir, order_by=["title"], schema=S3)
    back = read_archive(spark, tmp_dir, S3).first()
    assert back["month"] == "0704"


def test_null_id_rejected(spark, tmp_dir):
    df = spark.createDataFrame([(None, "t", "s"), ("2505.00009", "t", "s")], S3)
    with pytest.raises(Exception, match="null id"):
        upsert(df, tmp_dir, order_by=["title"], schema=S3)
    assert not os.path.exists(os.path.join(tmp_dir, "month=2505"))


def test_broken_line_is_an_error(spark, tmp_dir):
    upsert(spark.createDataFrame([("2505.00001", "t", "s")], S3), tmp_dir, order_by=["title"], schema=S3)
    with open(os.path.join(tmp_dir, "month=2505", "part-broken.json"), "w") as f:
        f.write('{"id":"2505.00002","title":"cut of')
    with pytest.raises(Exception):
        read_archive(spark, tmp_dir, S3).collect()
    with pytest.raises(Exception):
        upsert(spark.createDataFrame([("2505.00003", "t", "s")], S3), tmp_dir, order_by=["title"], schema=S3)


def test_narrower_batch_keeps_stored_fields(spark, tmp_dir):
    upsert(spark.createDataFrame([("2505.00001", "old", "s")], S3), tmp_dir, order_by=["title"], schema=S3)
    narrow = T.StructType(S3.fields[:2])
    upsert(spark.createDataFrame([("2505.00002", "new")], narrow), tmp_dir, order_by=["title"], schema=narrow)
    rows = {r["id"]: r for r in read_archive(spark, tmp_dir, S3).collect()}
    other = S3.fields[2].name
    assert rows["2505.00001"][other] == "s" and rows["2505.00002"][other] is None


def test_all_null_list_takes_the_batch_type(spark, tmp_dir):
    kinds = "id string, title string, tags array<string>"
    upsert(spark.createDataFrame([("2505.00001", "a", None)], kinds), tmp_dir, order_by=["title"])
    upsert(spark.createDataFrame([("2505.00002", "b", ["x"])], kinds), tmp_dir, order_by=["title"])
    got = {r["id"]: r["tags"] for r in spark.read.json(tmp_dir).collect()}
    assert got == {"2505.00001": None, "2505.00002": ["x"]}


def test_read_archive_missing_and_empty(spark, tmp_dir):
    missing = read_archive(spark, os.path.join(tmp_dir, "nope"))
    assert missing.columns == ["id", "summary"] and missing.count() == 0
    os.makedirs(os.path.join(tmp_dir, "empty"))
    empty = read_archive(spark, os.path.join(tmp_dir, "empty"), S3)
    assert empty.count() == 0
    no_schema = read_archive(spark, os.path.join(tmp_dir, "empty"))
    assert no_schema.columns == ["id", "summary"] and no_schema.count() == 0


def test_read_archive_several_files(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "arch", "month=0001")
    os.makedirs(folder)
    for k in range(2):
        with open(os.path.join(folder, f"part-{k}.json"), "w") as f:
            for j in range(2):
                f.write(json.dumps({"id": str(2 * k + j + 1), "summary": "s"}) + "\n")
    df = read_archive(spark, os.path.join(tmp_dir, "arch"))
    assert sorted(r.id for r in df.collect()) == ["1", "2", "3", "4"]
    assert F  # keep import


def test_dropped_rows_are_counted(spark, tmp_dir):
    rows = [("2505.00001", "T", "S"), ("2505.00002", None, None), ("2505.00003", " ", "")]
    stats = {}
    upsert(spark.createDataFrame(rows, S3), tmp_dir, order_by=["title"], stats=stats)
    assert stats["dropped"] == 2


def test_interrupted_commit_can_be_redone_from_stage(spark, tmp_dir):
    from papersift.sinks.archive import write_months

    upsert(spark.createDataFrame([("2505.00001", "a", "x")], S3), tmp_dir, order_by=["title"], schema=S3)
    stats = {}
    upsert(spark.createDataFrame([("2505.00002", "b", "y")], S3), tmp_dir, order_by=["title"], schema=S3, stats=stats)
    assert "staged" in stats
    write_months(spark.read.parquet(stats["staged"]), tmp_dir)  # a rerun gives the same archive
    assert sorted(r.id for r in read_archive(spark, tmp_dir, S3).collect()) == ["2505.00001", "2505.00002"]
