import pytest
import json
import os
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.operators import corpus
from papersift.plans import digest
from papersift.plans.recommend import recommend
from papersift.settings import Settings
from papersift.sources.corpus import scan_papers
from papersift.sources.preferences import read_preferences
from papersift.sources.vocabulary import read_vocabulary
from papersift.streaming import archive_stream

EMB = ("e1", "e2")


def _papers(spark, n=120):
    rows = []
    for i in range(n):
        cat = ["cs.CL"] if i % 3 else ["math.AG"]
        rows.append((f"2501.{i:05d}", f"T{i}", f"A{i}", cat, f"2025-01-{1 + i % 28:02d}",
                     [float((i * 7) % 11), float(i % 5)], [float((i * 3) % 7)]))
    schema = "id string, title string, abstract string, categories array<string>, updated string, " \
             "e1 array<float>, e2 array<float>"
    return spark.createDataFrame(rows, schema)


def test_scan_years_with_missing_columns(spark, tmp_dir):
    spark.createDataFrame([("1", "a")], "id string, title string").write.parquet(os.path.join(tmp_dir, "2024.parquet"))
    spark.createDataFrame([("2", "b", 1.0)], "id string, title string, extra double") \
        .write.parquet(os.path.join(tmp_dir, "2025.parquet"))
    df = scan_papers(spark, tmp_dir, [2024, 2025])
    got = {r.id: r.extra for r in df.collect()}
    assert got == {"1": None, "2": 1.0}
    assert scan_papers(spark, tmp_dir, []) is None


def test_read_preferences_keeps_text_ids(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "pref", "sub"))
    with open(os.path.join(tmp_dir, "pref", "init.csv"), "w") as f:
        f.write("id,preference\n2406.1,like\n2406.10,dislike\n2406.17808,dislike\n")
    with open(os.path.join(tmp_dir, "pref", "sub", "2025-05.csv"), "w") as f:
        f.write("id,preference\n2406.17808,like\n")
    df = read_preferences(spark, os.path.join(tmp_dir, "pref"))
    rows = sorted((r.id, r.preference) for r in df.collect())
    assert ("2406.1", "like") in rows and ("2406.10", "dislike") in rows
    assert len(rows) == 4
    fixed = sorted(r.id for r in read_preferences(spark, os.path.join(tmp_dir, "pref"), normalize_ids=True).collect())
    assert fixed == ["2406.10000", "2406.10000", "2406.17808", "2406.17808"]


def test_vocabulary(spark, tmp_dir):
    path = os.path.join(tmp_dir, "kw.json")
    with open(path, "w") as f:
        json.dump({"Models": ["LLMs", "Transformer"], "Tasks": ["Reasoning"]}, f, indent=2)
    got = sorted(tuple(r) for r in read_vocabulary(spark, path).collect())
    assert got == [("Models", "LLMs"), ("Models", "Transformer"), ("Tasks", "Reasoning")]


def test_recommend_end_to_end(spark):
    papers = _papers(spark)
    prefs = spark.createDataFrame([(f"2501.{i:05d}", "like" if i % 2 else "dislike") for i in range(1, 30, 3)],
                                  "id string, preference string")
    s = Settings(categories=("cs.CL",), embedding_columns=EMB, bg_sample_rate=1.0, sample_rate=0.1,
                 start_date="2025-01-01", end_date="2025-01-31", background_start_year=2024,
                 preference_start_year=2025)
    shown = recommend(papers, prefs, s)
    rows = shown.collect()
    assert len(rows) == max(1, int(0.1 * (80 - 10)))  # unrated cs.CL papers
    assert all(r.show == 1 for r in rows) and "e1" not in shown.columns
    assert corpus.needs_year_cutoff(2024, 2025) is False


def test_daily_run_writes_result_and_archive(spark, tmp_dir):
    papers = _papers(spark)
    prefs = spark.createDataFrame([(f"2501.{i:05d}", "like" if i % 2 else "dislike") for i in range(1, 30, 3)],
                                  "id string, preference string")
    s = Settings(categories=("cs.CL",), embedding_columns=EMB, bg_sample_rate=1.0, sample_rate=0.1,
                 start_date="2025-01-01", end_date="2025-01-31", language="en", acceptable_cache_models=("m",))
    cache = spark.createDataFrame([], "id string, model string, lang string, summary_time string, one_sentence_summary string")
    fields = T.StructType([T.StructField("one_sentence_summary", T.StringType())])
    failed = digest.run_daily(spark, papers, prefs, os.path.join(tmp_dir, "archive"), os.path.join(tmp_dir, "out"),
                              cache, lambda r: {"one_sentence_summary": r["title"] + "."}, fields, s)
    assert failed.count() == 0
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert out.count() == 7 and set(out.columns) >= {"id", "title", "score", "one_sentence_summary", "summary_time"}
    archived = spark.read.json(os.path.join(tmp_dir, "archive"))
    assert archived.count() == 7


def test_stream_upserts_landing_files(spark, tmp_dir):
    landing, archive = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "archive")
    os.makedirs(landing)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
                           T.StructField("summary_time", T.StringType())])
    with open(os.path.join(landing, "a.json"), "w") as f:
        f.write(json.dumps({"id": "2501.00001", "title": "one", "summary_time": "1"}) + "\n")
        f.write(json.dumps({"id": "2502.00002", "title": "two", "summary_time": "1"}) + "\n")
    q = archive_stream.start(spark, landing, archive, schema, checkpoint=os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    with open(os.path.join(landing, "b.json"), "w") as f:
        f.write(json.dumps({"id": "2501.00001", "title": "one v2", "summary_time": "2"}) + "\n")
    time.sleep(1)
    q = archive_stream.start(spark, landing, archive, schema, checkpoint=os.path.join(tmp_dir, "ck"), available_now=True)
    q.awaitTermination(120)
    got = {r.id: r.title for r in spark.read.json(archive).collect()}
    assert got == {"2501.00001": "one v2", "2502.00002": "two"}
    assert F  # keep import


def test_preferences_without_files_and_by_uri(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        read_preferences(spark, tmp_dir)
    with open(os.path.join(tmp_dir, "a.csv"), "w") as f:
        f.write("id,preference\n2406.1,like\n")
    assert [r["id"] for r in read_preferences(spark, f"file://{tmp_dir}").collect()] == ["2406.1"]


def test_named_run_and_required_fields(spark, tmp_dir):
    papers = _papers(spark)
    prefs = spark.createDataFrame([(f"2501.{i:05d}", "like" if i % 2 else "dislike") for i in range(1, 30, 3)], "id string, preference string")
    s = Settings(categories=("cs.CL",), embedding_columns=EMB, bg_sample_rate=1.0, language="en", acceptable_cache_models=("m",), workers=2,
                 required_text=("one_sentence_summary",))
    cache = spark.createDataFrame([], "id string, model string, lang string, summary_time string, one_sentence_summary string")
    fields = T.StructType([T.StructField("one_sentence_summary", T.StringType())])
    ids = ["2501.00002", "2501.00003"]
    failed = digest.run_named(spark, papers, prefs, ids, os.path.join(tmp_dir, "archive"), os.path.join(tmp_dir, "out"), cache,
                              lambda r: {"one_sentence_summary": None if r["id"].endswith("3") else "x."}, fields, s)
    assert [(r["id"], r["error"]) for r in failed.collect()] == [("2501.00003", "missing fields: one_sentence_summary")]
    assert [r["id"] for r in spark.read.json(os.path.join(tmp_dir, "archive")).collect()] == ["2501.00002"]


def test_year_is_kept_after_the_cutoff(spark):
    papers = _papers(spark)
    prefs = spark.createDataFrame([(f"2501.{i:05d}", "like" if i % 2 else "dislike") for i in range(1, 30, 3)], "id string, preference string")
    s = Settings(categories=("cs.CL",), embedding_columns=EMB, bg_sample_rate=1.0, sample_rate=0.1, start_date="2025-01-01", end_date="2025-01-31",
                 background_start_year=2024, preference_start_year=2023)
    assert corpus.needs_year_cutoff(2024, 2023)
    assert {r["year"] for r in recommend(papers, prefs, s).collect()} == {2025}


def test_years_have_one_schema_each(spark, tmp_dir):
    """Columns in another order, missing or of a wider type; years that are not wanted are not opened."""
    for layout, name in (("files", "{y}.parquet"), ("partitions", "year={y}")):
        root = os.path.join(tmp_dir, layout)
        spark.createDataFrame([("a", 1)], "id string, n int").write.parquet(os.path.join(root, name.format(y=2021)))
        spark.createDataFrame([(2.5, "b", [1.0])], "x double, id string, e array<double>").write.parquet(os.path.join(root, name.format(y=2022)))
        spark.createDataFrame([(3, "c")], "n long, id string").write.parquet(os.path.join(root, name.format(y=2023)))
        os.makedirs(os.path.join(root, name.format(y=2020)))
        with open(os.path.join(root, name.format(y=2020), "part-0.parquet"), "w") as f:
            f.write("broken")
        rows = scan_papers(spark, root, [2021, 2022, 2023], layout).collect()
        assert sorted((r.id, r.n, r.x, r.e) for r in rows) == [("a", 1, None, None), ("b", None, 2.5, [1.0]), ("c", 3, None, None)]
        if layout == "partitions":
            assert sorted((r.id, r.year) for r in rows) == [("a", 2021), ("b", 2022), ("c", 2023)]
            assert scan_papers(spark, root, [1999], layout) is None
            assert scan_papers(spark, root, [1999, 2021], layout).count() == 1


def test_global_rank(spark):
    from pyspark.sql import functions as F

    from papersift.operators.rank import global_rank

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("__n"))
    got = global_rank(df.repartition(7), ["v"]).collect()
    assert all(r["rank"] == r.v + 1 for r in got) and len(got) == 5000
    down = global_rank(df, [F.col("v").desc()], "place").collect()
    assert all(r.place == 5000 - r.v for r in down)
    ties = global_rank(spark.createDataFrame([(1,), (1,), (None,)], "v int"), ["v"])
    assert sorted(r["rank"] for r in ties.collect()) == [1, 2, 3] and ties.where("v IS NULL").first()["rank"] == 1
    assert global_rank(df.limit(0), ["v"]).count() == 0


def test_model_of_given_coefficients(spark):
    import math

    from papersift.operators.scoring import score
    from papersift.operators.training import given_model

    df = spark.createDataFrame([("a", [1.0, 2.0], [0.5]), ("b", [0.0, 0.0], [0.0])], "id string, e array<double>, f array<double>")
    got = {r.id: r.score for r in score(given_model(spark, [0.5, -1.0, 2.0], 0.25), df, ("e", "f")).collect()}
    assert abs(got["a"] - 1 / (1 + math.exp(-(0.5 - 2.0 + 1.0 + 0.25)))) < 1e-12 and abs(got["b"] - 1 / (1 + math.exp(-0.25))) < 1e-12


def test_late_columns_are_read_from_the_files_of_chosen_rows(spark, tmp_dir):
    from pyspark.sql import functions as F

    from papersift.sources import positions

    path = os.path.join(tmp_dir, "p")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("e"), F.lit("x").alias("other"))
    rows.repartitionByRange(20, F.col("id").cast("int")).write.parquet(path)
    scan = positions.with_positions(spark.read.parquet(path))
    wide = scan.select("e").schema
    chosen = scan.select("id", positions.FILE, positions.ROW).where(F.col("id").cast("int").between(150, 260)).withColumn("label", F.lit(1))
    got = positions.fetch(chosen.union(chosen.where("id = '200'")), wide)
    assert got.columns == ["id", "label", "e"]
    assert sorted((int(r.id), r.e) for r in got.collect()) == sorted([(k, [k * 1.0, k * 2.0]) for k in [*range(150, 261), 200]])
    files = {r[0] for r in chosen.select(positions.FILE).distinct().collect()}
    assert len(files) <= 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f"InMemoryFileIndex({len(files)} paths)" in plan and "ReadSchema: struct<e:array<double>," in plan
    assert positions.fetch(chosen.limit(0), wide).count() == 0


def test_recommend_with_positions_equals_the_keyed_join(spark, tmp_dir):
    from papersift.plans import flagship
    from papersift.plans import testdata as td
    from papersift.plans.recommend import recommend
    from papersift.sources import positions

    sf = "/root/testdata/sf0.001"
    path = os.path.join(tmp_dir, "papers")
    td.papers(spark, sf).repartition(4).write.parquet(path)
    papers, prefs = spark.read.parquet(path), td.preferences(spark, sf)
    a = recommend(papers, prefs, flagship.FLAGSHIP_SETTINGS)
    b = recommend(positions.with_positions(papers), prefs, flagship.FLAGSHIP_SETTINGS)
    assert a.columns == b.columns
    assert sorted((r.id, round(r.score, 6)) for r in a.collect()) == sorted((r.id, round(r.score, 6)) for r in b.collect())
