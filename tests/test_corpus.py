import datetime as dt

from pyspark.sql import functions as F

from papersift.operators import corpus
from papersift.sources.corpus import years_to_scan


def test_split_and_anti_join(spark):
    papers = spark.createDataFrame([("1", "a"), ("2", "b"), ("5", "c"), ("6", "d"), (None, "e")], "id string, title string")
    prefs = spark.createDataFrame([("1", "like"), ("2", "dislike")], "id string, preference string")
    rated, unrated = corpus.split_rated(papers, prefs)
    assert sorted(r.id for r in rated.collect()) == ["1", "2"]
    assert sorted(r.id for r in unrated.collect()) == ["5", "6"]  # null id is in neither


def test_remove_digested_cases(spark):
    cands = spark.createDataFrame([("1", "a"), ("2", "b"), ("5", "c"), ("6", "d")], "id string, title string")
    archive = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    assert sorted(r.id for r in corpus.remove_digested(cands, archive).collect()) == ["5", "6"]
    no_archive = spark.createDataFrame([], "id string")
    assert corpus.remove_digested(cands, no_archive).count() == 4
    empty = spark.createDataFrame([], "id string, title string")
    out = corpus.remove_digested(empty, archive)
    assert out.count() == 0 and out.columns == ["id", "title"]


def test_category_filter_and_embeddings(spark):
    df = spark.createDataFrame([("1", ["cs.CL"], [1.0]), ("2", ["math.AG"], [1.0]), ("3", None, [1.0]),
                                ("4", ["cs.LG"], None)], "id string, categories array<string>, e array<double>")
    out = corpus.with_all_embeddings(corpus.category_any(df, ["cs.CL", "cs.LG"]), ["e"])
    assert [r.id for r in out.collect()] == ["1"]


def test_date_window_rules(spark):
    df = spark.createDataFrame([("1", "2025-01-01"), ("2", "2025-01-05"), ("3", "2025-01-10")], "id string, updated string")
    both = corpus.date_window(df, "2025-01-01", "2025-01-05")
    assert sorted(r.id for r in both.collect()) == ["1", "2"]
    last = corpus.date_window(df, last_n_days=7, today=dt.date(2025, 1, 12))
    assert sorted(r.id for r in last.collect()) == ["2", "3"]
    one_bound = corpus.date_window(df, start_date="2025-01-01", last_n_days=7, today="2025-01-12")
    assert sorted(r.id for r in one_bound.collect()) == ["2", "3"]


def test_year_cutoff_and_years():
    assert corpus.effective_start_year(2024, 2023) == 2023
    assert corpus.needs_year_cutoff(2024, 2023)
    assert not corpus.needs_year_cutoff(2024, 2025)
    assert corpus.effective_start_year(2024, 2010) == 2017
    assert years_to_scan(2024, 2023, current_year=2025) == [2023, 2024, 2025]
    assert years_to_scan(2030, 2031, current_year=2025) == []


def test_year_cutoff_column(spark):
    df = spark.createDataFrame([("1", "2023-12-31"), ("2", "2024-01-01")], "id string, updated string")
    out = corpus.year_cutoff(df, 2024)
    assert [(r.id, r.year) for r in out.collect()] == [("2", 2024)]


def test_id_list_helpers(spark):
    assert corpus.parse_ids(" 2401.00001, ,2312.00002 ,") == ["2401.00001", "2312.00002"]
    assert corpus.start_year_of_ids(["2401.00001", "2312.00002"]) == 2023
    from papersift.functions.text import parse_id_list

    got = spark.range(1).select(parse_id_list(F.lit(" a, ,b ,")).alias("x")).first().x
    assert got == ["a", "b"]


def test_joins_run_nothing_while_planning_and_gather_nothing(spark):
    """No row count in one task, and no job before the result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    papers = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    some = papers.where("id % 3 = 0")
    frames = [*corpus.split_rated(papers, some.withColumn("preference", F.lit("like"))), corpus.remove_digested(papers, some),
              corpus.id_list_filter(papers, some)]
    assert len(tracker.getJobIdsForGroup(None)) == before
    for df in frames:
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
    assert [df.count() for df in frames] == [334, 666, 666, 334]
