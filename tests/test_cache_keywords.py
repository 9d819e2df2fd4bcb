from pyspark.sql import functions as F

from papersift.operators import cache, dedup, keywords

CACHE_COLS = "id string, model string, lang string, summary_time string, summary string"

from papersift.operators import keywords


def test_model_patterns_are_regexes(spark):
    df = spark.createDataFrame([("gro-x",), ("grok-3",), ("xgrok",), ("deepseek-r1",), ("gemini-2",), ("gpt",)], "model string")
    pat = cache.model_pattern(["grok*", "deepseek*", "gemini*"])
    assert sorted(r.model for r in df.where(F.col("model").rlike(pat)).collect()) == \
        ["deepseek-r1", "gemini-2", "gro-x", "grok-3"]


def test_latest_cached_hits_and_misses(spark):
    c = spark.createDataFrame([
        ("2310.03903", "grok-3", "zh", "2025-01-01", "old"),
        ("2310.03903", "grok-3", "zh", "2025-02-01", "new"),
        ("2410.12735", "gemini-2.5", "zh", "2025-01-01", "x"),
        ("2410.12735", "gpt-4", "zh", "2025-03-01", "not accepted"),
        ("2410.12735", "grok-3", "en", "2025-03-01", "wrong language"),
    ], CACHE_COLS)
    wanted = spark.createDataFrame([("2310.03903",), ("2410.12735",), ("9999.00000",), ("8888.00000",)], "id string")
    got = {r.id: (r.summary, r.preference) for r in cache.latest_cached(c, wanted, "zh", ["grok*", "gemini*"]).collect()}
    assert got == {"2310.03903": ("new", "unknown"), "2410.12735": ("x", "unknown")}
    only_unknown = spark.createDataFrame([("9999.00000",), ("8888.00000",)], "id string")
    assert cache.latest_cached(c, only_unknown, "zh", ["grok*"]).count() == 0
    miss = cache.misses(wanted, cache.latest_cached(c, wanted, "zh", ["grok*", "gemini*"]))
    assert sorted(r.id for r in miss.collect()) == ["8888.00000", "9999.00000"]


def test_combine_cached_wins_and_metadata_merge(spark):
    fresh = spark.createDataFrame([("1", "fresh"), ("2", "fresh")], "id string, summary string")
    cached = spark.createDataFrame([("2", "cached", "c"), ("3", "cached", None)], "id string, summary string, title string")
    both = {r.id: r.summary for r in cache.combine(fresh, cached).collect()}
    assert both == {"1": "fresh", "2": "cached", "3": "cached"}
    papers = spark.createDataFrame([("2", None, 0.9), ("1", "P1", 0.5)], "id string, title string, score double")
    merged = {r.id: (r.title, r.score) for r in cache.merge_metadata(cache.combine(fresh, cached), papers).collect()}
    # the paper wins even with a null title; a summary with no paper keeps its own values
    assert merged == {"1": ("P1", 0.5), "2": (None, 0.9), "3": (None, None)}


def test_dedupe_ratings_is_deterministic(spark):
    df = spark.createDataFrame([
        ("2406.17808", "dislike", "a/init.csv"), ("2406.17808", "like", "a/init.csv"),
        ("2406.1", "like", "a/init.csv"), ("2406.10", "dislike", "a/init.csv"),
        ("1", "like", "a/init.csv"), ("1", "dislike", "b/2025-05.csv"),
    ], "id string, preference string, source_file string")
    got = {r.id: r.preference for r in dedup.dedupe_ratings(df).collect()}
    assert got == {"2406.17808": "like", "2406.1": "like", "2406.10": "dislike", "1": "dislike"}


def test_key_prefixes(spark):
    df = spark.createDataFrame([("2401.00001",), ("2401.00002",), ("abc",), ("2312.1",)], "id string")
    assert sorted(r.month for r in dedup.key_prefixes(df).collect()) == ["2312", "2401"]


def _kw_frame(spark):
    return spark.createDataFrame(
        [("1", ["LLM", "Vision"]), ("2", None), ("3", []), ("4", ["Efficient Adaptive System", "LLM", "LLMs"]),
         ("5", ["LLM", None])],
        "id string, keywords array<string>")


MAPPING = {"LLM": ["LLMs"], "Efficient Adaptive System": ["Efficient", "Adaptive System"], "Vision": []}


def test_rewrite_with_dict(spark):
    got = {r.id: r.keywords for r in keywords.rewrite_with_dict(_kw_frame(spark), MAPPING).collect()}
    assert got == {"1": ["LLMs", "Vision"], "2": None, "3": [],
                   "4": ["Adaptive System", "Efficient", "LLMs"], "5": ["LLMs", None]}


def test_rewrite_with_table_equals_dict(spark):
    m = spark.createDataFrame([(k, v) for k, v in MAPPING.items()], "key string, values array<string>")
    a = {r.id: r.keywords for r in keywords.rewrite_with_table(_kw_frame(spark), m).collect()}
    b = {r.id: r.keywords for r in keywords.rewrite_with_dict(_kw_frame(spark), MAPPING).collect()}
    assert a == b


def test_mapping_last_key_wins_and_missing_column(spark):
    recs = spark.createDataFrame([("LLM", ["A"], 1), ("LLM", ["B"], 2)], "key string, values array<string>, n int")
    assert [tuple(r) for r in keywords.mapping_table(recs, "n").collect()] == [("LLM", ["B"])]
    df = spark.createDataFrame([("1",)], "id string")
    assert keywords.rewrite_with_dict(df, MAPPING).columns == ["id"]
    counts = {r.keyword: r.n for r in keywords.keyword_counts(_kw_frame(spark)).collect()}
    assert counts["LLM"] == 3


def test_cache_scan_reads_only_wanted_months(spark, tmp_path):
    import json
    import os

    from pyspark.sql import types as T

    from papersift.sources.cache import read_cache

    root = str(tmp_path / "cache")
    for month, ids in {"2310": ["2310.03903"], "2410": ["2410.12735"], "2501": ["2501.00001"]}.items():
        os.makedirs(os.path.join(root, f"month={month}"))
        with open(os.path.join(root, f"month={month}", "part-0.json"), "w") as f:
            for i in ids:
                f.write(json.dumps({"id": i, "model": "grok-3", "lang": "zh", "summary_time": "t"}) + "\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "model", "lang", "summary_time")])
    spark.createDataFrame([("2310.03903",), ("2410.12735",), ("9999.00000",)], "id string").write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.parquet(str(tmp_path / "wanted"))
    df = read_cache(spark, root, wanted, schema)
    assert sorted(r.id for r in df.collect()) == ["2310.03903", "2410.12735"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "BroadcastExchange" in plan
    same = read_cache(spark, root, wanted.union(wanted), schema)
    assert sorted(r.month for r in same.collect()) == ["2310", "2410"]  # repeated ids, one row each
    none = read_cache(spark, root, spark.createDataFrame([("bad",)], "id string"), schema)
    assert none.count() == 0
    missing = read_cache(spark, str(tmp_path / "nope"), wanted, schema)
    assert missing.count() == 0


def test_hot_key_is_combined_before_the_shuffle(spark):
    """One id holds a third of all rows: the newest-per-id aggregate is combined
    map-side, so the shuffle carries at most one row per task for it."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    out = dedup.latest_per_key(df, "id", ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    rows = {r.id: (r.t, r.v) for r in out.collect()}
    assert len(rows) == n - n // 3 + 1
    assert rows["hot"] == (n - 3, 2 * (n - 3))


def test_rewrite_with_table_null_and_repeated_ids(spark):
    rows = [(None, ["a", "b"], 1), ("x", ["a"], 1), ("x", ["c"], 1), ("x", ["c"], 1), ("y", None, 1), ("z", [], None)]
    df = spark.createDataFrame(rows, "id string, keywords array<string>, extra int")
    mapping = spark.createDataFrame([("a", ["A1", "A2"]), ("c", [])], "key string, values array<string>")
    out = keywords.rewrite_with_table(df, mapping)
    got = sorted(((r.id, r.keywords, r.extra) for r in out.collect()), key=str)
    assert out.columns == df.columns
    assert got == sorted([(None, ["A1", "A2", "b"], 1), ("x", ["A1", "A2"], 1), ("x", ["c"], 1), ("x", ["c"], 1), ("y", None, 1), ("z", [], None)], key=str)


def test_a_keyword_in_half_of_all_rows(spark):
    """The hot keyword is mapped without the join: no task of the join gets it."""
    n = 40_000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("hot"), F.concat(F.lit("k"), F.col("id") % 5000))).otherwise(
            F.array(F.concat(F.lit("k"), F.col("id") % 5000), F.lit(None).cast("string"))).alias("keywords"))
    records = [("hot", ["warm", "cold"])] + [(f"k{k}", [f"m{k}"]) for k in range(0, 5000, 2)] + [("k4", None)]
    mapping = keywords.mapping_table(spark.createDataFrame(records, "key string, values array<string>"))
    assert keywords.hot_keywords(rows) == ["hot"]
    out = keywords.rewrite_with_table(rows, mapping)
    got = {r.id: r.keywords for r in out.collect()}
    assert len(got) == n

    def want(k):
        own = f"k{k % 5000}"
        mapped = [own] if k % 5000 % 2 else [f"m{k % 5000}"]
        return sorted(["warm", "cold"] + mapped) if k % 2 == 0 else sorted(mapped)

    assert all([x for x in got[str(k)] if x is not None] == want(k) for k in range(n))
    assert all((None in got[str(k)]) == (k % 2 == 1) for k in range(0, n, 97))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT" in plan and "hot" in plan  # the join's side is without the hot keyword
