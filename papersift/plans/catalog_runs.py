"""Registered queries that run sources, sinks and whole operators end to end: what is written is read back, and the
DuckDB oracle computes the rows from the driver's tables.  Scratch folders lie below spark.checkpoint.dir."""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.plans import testdata as td
from papersift.plans import token_docs as tk
from papersift.plans.catalog import (
    _MAIN_DRAW_SQL, ARCHIVE_BATCH_SQL, BG_RATE, FIRST_SENTENCE, TRAINING_SQL, _archive_batch, _cte, _documents_as_papers, _main_draw, first_sentence_digest,
    register,
)
from papersift.session import ensure_checkpoint_dir, scratch_path


def _scratch(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, name)


# ---------------------------------------------------------------- renderer rules without a row so far

def _rules(**opts):
    def q(spark, sf):
        from papersift.operators.render import render

        ensure_checkpoint_dir(spark)
        return render(tk.part_rules(spark, sf), **opts)
    return q


register("render_rules", tk.part_rules_sql())(_rules())
register("render_no_references", tk.part_rules_sql(ignore_reference=True))(_rules(ignore_reference=True))
register("render_no_bibliography", tk.part_rules_sql(ignore_reference=True, drop_bibliography=True))(
    _rules(ignore_reference=True, drop_bibliography=True))


# ---------------------------------------------------------------- cache scan by month

CACHE_ROWS_SQL = f"SELECT {td.ARCHIVE_ID_SQL} AS id, o_orderpriority AS model, o_totalprice AS price, o_orderstatus, o_orderdate FROM orders"
CACHE_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("model", T.StringType()), T.StructField("price", T.DoubleType())])


@register("cache_scan", _cte(c=CACHE_ROWS_SQL) + """
, wanted AS (SELECT id FROM c WHERE o_orderstatus = 'F' AND o_orderdate < DATE '1996-06-01')
SELECT id, model, price, substr(id, 1, 4) AS month FROM c WHERE substr(id, 1, 4) IN (SELECT substr(id, 1, 4) FROM wanted)
""")
def q_cache_scan(spark, sf):
    """A cache of all orders by month; only the months of the wanted ids are scanned, pruned at run time."""
    from papersift.sources.cache import read_cache

    o = td.table(spark, sf, "orders")
    root = _scratch(spark, "cache")
    rows = o.select(td.archive_id().alias("id"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("price"))
    rows.withColumn("month", F.substring("id", 1, 4)).write.partitionBy("month").json(root)
    wanted = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < "1996-06-01")).select(td.archive_id().alias("id"))
    return read_cache(spark, root, wanted, CACHE_SCHEMA)


# ---------------------------------------------------------------- archive with several writers (K2)

ARCHIVE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("version", T.IntegerType())])


@register("archive_writers", _cte(
    b1=ARCHIVE_BATCH_SQL.replace("__V__", "1"),
    b2=ARCHIVE_BATCH_SQL.replace("__V__", "2") + " WHERE o_orderstatus = 'F'",
) + """
, old AS (SELECT * FROM b1 WHERE o_orderstatus <> 'P')
SELECT id, substr(id, 1, 4) AS month, title, summary, round(score, 2) AS score, version FROM b2
UNION ALL
SELECT id, substr(id, 1, 4), title, summary, round(score, 2), version FROM old WHERE id NOT IN (SELECT id FROM b2)
""")
def q_archive_writers(spark, sf):
    """Three writers upsert thirds of version 1 at the same time, all into the same months; then two upsert halves of
    version 2.  Nothing is lost."""
    from papersift.sinks import versioned
    from papersift.sinks.archive import upsert
    from papersift.sources.archive import read_archive

    path = _scratch(spark, "archive")
    versioned.create(spark, path)

    def write(version: int, parts: int) -> None:
        batch = _archive_batch(spark, sf, version)
        share = F.pmod(F.xxhash64("id"), F.lit(parts))
        with ThreadPoolExecutor(parts) as pool:
            for done in [pool.submit(upsert, batch.where(share == k), path, ["version"], ARCHIVE_SCHEMA) for k in range(parts)]:
                done.result()

    write(1, 3)
    write(2, 2)
    back = read_archive(spark, path, ARCHIVE_SCHEMA)
    return back.select("id", "month", "title", "summary", F.round("score", 2).alias("score"), "version")


@register("archive_dropped", _cte(b1=ARCHIVE_BATCH_SQL.replace("__V__", "1")) + """
SELECT substr(id, 1, 4) AS month, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus <> 'P') AS kept FROM b1 GROUP BY 1
""")
def q_archive_dropped(spark, sf):
    """A10: rows and rows with content of each month of a batch (one row a month, as the upsert takes them)."""
    from papersift.operators.archive import month_summary

    found = [(r["month"], r["rows"], r["kept"]) for r in month_summary(_archive_batch(spark, sf, 1))]
    return spark.createDataFrame(found, "month string, n_rows long, kept long")


# ---------------------------------------------------------------- enrichment

def waiting_digest(row: dict) -> dict:
    """The per-paper function of the tests, as slow as a short call to a service."""
    time.sleep(0.001)
    return first_sentence_digest(row)


@register("enrich_in_flight", f"""
SELECT CAST(doc_id AS VARCHAR) AS id, nullif(regexp_extract(text, '{FIRST_SENTENCE}', 1), '') AS one_sentence_summary,
       CASE WHEN regexp_extract(text, '{FIRST_SENTENCE}', 1) = '' THEN 'ValueError: no complete sentence' END AS error
FROM documents
""")
def q_enrich_in_flight(spark, sf):
    """Calls that wait, 64 in flight over all tasks; failed rows have their error."""
    from papersift.operators import enrich as en

    tasks, in_flight = en.shares(64, spark.sparkContext.defaultParallelism)
    fields = T.StructType([T.StructField("one_sentence_summary", T.StringType())])
    out = en.apply_per_row(_documents_as_papers(spark, sf), waiting_digest, fields, num_partitions=tasks, in_flight=in_flight)
    return out.select("id", "one_sentence_summary", "error")


def _model_texts(spark, sf) -> DataFrame:
    """What a model may answer for each document: a fenced record, a plain one, one without a field, one that is cut
    off, and nothing."""
    d = td.table(spark, sf, "documents")
    kind = F.col("doc_id") % 5
    doc = F.col("doc_id").cast("string")
    full = F.concat(F.lit('{"institution":["I'), doc, F.lit('"],"reasoning_step":"r","problem_background":"p","method":"'), F.col("lang"), F.lit(
        '","experiment":"e","one_sentence_summary":"s'), doc, F.lit('","slug":"doc-'), doc, F.lit('","keywords":["k1","k2"],"further_thoughts":"f"}'))
    raw = (F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(kind == 1, full)
           .when(kind == 2, F.concat(F.lit('{"institution":["I'), doc, F.lit('"],"method":"m"}')))
           .when(kind == 3, F.substring(full, 1, 40)).otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("  "))))
    return d.select(doc.alias("id"), raw.alias("raw"))


@register("digest_records", """
SELECT CAST(doc_id AS VARCHAR) AS id, 'I' || doc_id AS institution, lang AS method, 's' || doc_id AS one_sentence_summary,
       'doc-' || doc_id AS slug, 'k1,k2' AS keywords FROM documents WHERE doc_id % 5 IN (0, 1)
""")
def q_digest_records(spark, sf):
    from papersift.operators import enrich as en

    ensure_checkpoint_dir(spark)
    records, _ = en.route_digests(_model_texts(spark, sf), "raw")
    return records.select("id", F.array_join("institution", ",").alias("institution"), "method", "one_sentence_summary", "slug", F.array_join("keywords", ",").alias("keywords"))


@register("digest_errors", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CASE doc_id % 5 WHEN 2 THEN 'missing fields' WHEN 3 THEN 'malformed' ELSE 'no text' END AS kind,
       CASE WHEN doc_id % 5 = 2 THEN 'reasoning_step,problem_background,experiment,one_sentence_summary,slug,keywords,further_thoughts' END AS fields,
       CASE WHEN doc_id % 5 = 3 THEN substr('{"institution":["I' || doc_id || '"],"reasoning_step":"r","problem_background":"p"', 1, 40) END AS text
FROM documents WHERE doc_id % 5 IN (2, 3, 4)
""")
def q_digest_errors(spark, sf):
    from papersift.operators import enrich as en

    ensure_checkpoint_dir(spark)
    _, errors = en.route_digests(_model_texts(spark, sf), "raw")
    return errors.select("id", "kind", F.array_join("fields", ",").alias("fields"), "text")


# ---------------------------------------------------------------- order as rank (T2 T3 K3), ratings files

@register("ranked_ratings", """
SELECT id, preference, row_number() OVER (ORDER BY id) AS rank FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'like' ELSE 'dislike' END AS preference FROM labels)
""")
def q_ranked_ratings(spark, sf):
    """A ratings CSV is written (K3) and read back; the rank is that of the rows in the files, so it shows their order."""
    from papersift.operators.rank import global_rank
    from papersift.sinks.files import write_ratings_csv

    path = _scratch(spark, "ratings")
    lab = td.table(spark, sf, "labels")
    write_ratings_csv(lab.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("quality") == 1, "like").otherwise("dislike").alias("preference")), path)
    back = spark.read.option("header", True).schema("id string, preference string").csv(path)
    placed = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return global_rank(placed, ["file", "block", "line"]).select("id", "preference", "rank")


@register("ranked_archive", _cte(b1=ARCHIVE_BATCH_SQL.replace("__V__", "1")) + """
SELECT id, substr(id, 1, 4) AS month, row_number() OVER (ORDER BY substr(id, 1, 4), id) AS rank FROM b1 WHERE o_orderstatus <> 'P'
""")
def q_ranked_archive(spark, sf):
    """The rank of every archived row by month, part file and line, which is its rank by month and id."""
    from papersift.operators.rank import global_rank
    from papersift.sinks.archive import upsert

    path = _scratch(spark, "archive")
    upsert(_archive_batch(spark, sf, 1), path, order_by=["version"], schema=ARCHIVE_SCHEMA)
    back = spark.read.schema("id string, month string").json(path)
    placed = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return global_rank(placed, ["month", "file", "block", "line"]).select("id", "month", "rank")


@register("ratings_files", """
WITH r AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 1 THEN 'like' ELSE 'dislike' END AS preference, 0 AS file FROM labels
  UNION ALL
  SELECT CAST(doc_id + 1 AS VARCHAR), CASE WHEN toxic = 1 THEN 'neutral' WHEN quality = 1 THEN 'like' ELSE 'dislike' END, 1 FROM labels)
SELECT id, preference, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file DESC,
  list_position(['dislike', 'neutral', 'like'], preference) DESC) AS rn FROM r) WHERE rn = 1
""")
def q_ratings_files(spark, sf):
    """Two rating files are written, found below a folder and read; the later file wins."""
    from papersift.operators.dedup import dedupe_ratings
    from papersift.plans.catalog import _two_rating_files
    from papersift.sources.preferences import read_preferences

    folder = _scratch(spark, "preference")
    rated = _two_rating_files(spark, sf)
    for k, name in enumerate(("ratings/0-init.csv", "ratings/1-update.csv")):
        rated.where(F.col("source_file") == name).select("id", "preference").write.option("header", True).csv(os.path.join(folder, f"{k}"))
    found = dedupe_ratings(read_preferences(spark, folder).withColumn("source_file", F.regexp_extract("source_file", r"/(\d)/[^/]*$", 1)))
    return found.select("id", "preference", F.col("source_file").cast("int").alias("file"))


# ---------------------------------------------------------------- scans

@register("scan_years", """
SELECT doc_id, lang, CASE WHEN doc_id % 4 <> 1 THEN source END AS source, CASE WHEN doc_id % 4 >= 2 THEN n_chars END AS n_chars
FROM documents WHERE doc_id % 4 BETWEEN 1 AND 3
""")
def q_scan_years(spark, sf):
    """Documents written as four years whose columns differ; three of them are read as one table."""
    from papersift.sources.corpus import scan_papers

    d = td.table(spark, sf, "documents").drop("text")
    root = _scratch(spark, "years")
    columns = {0: ["doc_id"], 1: ["doc_id", "lang"], 2: ["lang", "n_chars", "doc_id", "source"], 3: d.columns}
    for k, names in columns.items():
        d.where(F.col("doc_id") % 4 == k).select(names).write.parquet(os.path.join(root, f"{2020 + k}.parquet"))
    return scan_papers(spark, root, [2021, 2022, 2023]).select("doc_id", "lang", "source", "n_chars")


@register("result_files", _cte(papers=td.PAPERS_SQL) + "SELECT id, title, updated, categories[1] AS lang FROM papers WHERE emb_a IS NOT NULL")
def q_result_files(spark, sf):
    """Papers without their embeddings, written as the Parquet result and read back."""
    from papersift.operators.scoring import drop_embeddings
    from papersift.sinks.files import write_parquet
    from papersift.sources.corpus import read_parquet

    path = _scratch(spark, "result")
    papers = td.papers(spark, sf).where(F.col("emb_a").isNotNull())
    write_parquet(drop_embeddings(papers, td.EMBEDDING_COLUMNS), path)
    back = read_parquet(spark, path)
    assert not set(td.EMBEDDING_COLUMNS) & set(back.columns)
    return back.select("id", "title", "updated", F.col("categories")[0].alias("lang"))


@register("training_rows_late", TRAINING_SQL + """
SELECT t.id, t.label, t.origin, round(CAST(p.emb_a[1] AS DOUBLE), 6) AS first, round(CAST(p.emb_b[32] AS DOUBLE), 6) AS last
FROM training t JOIN papers p ON t.id = p.id
""")
def q_training_rows_late(spark, sf):
    """The training rows are chosen on ids; their embeddings are read afterwards, by file and row position."""
    from papersift.operators import corpus, training
    from papersift.sources import positions

    path = _scratch(spark, "papers")
    papers = corpus.with_all_embeddings(td.papers(spark, sf), list(td.EMBEDDING_COLUMNS))
    papers.drop("abstract").repartition(16, "id").write.parquet(path)
    scan = positions.with_positions(spark.read.parquet(path))
    index = scan.select("id", positions.FILE, positions.ROW)
    rated, unrated = corpus.split_rated(index, td.preferences(spark, sf))
    keys = training.training_keys(rated, unrated, BG_RATE, 42)
    rows = positions.fetch(keys.join(index, "id"), T.StructType([scan.schema[c] for c in td.EMBEDDING_COLUMNS]))
    return rows.select("id", "label", "origin", F.round(F.col("emb_a")[0].cast("double"), 6).alias("first"), F.round(F.col("emb_b")[31].cast("double"), 6).alias("last"))


# ---------------------------------------------------------------- display, table size, keyword map, vocabulary

@register("shown_papers", _MAIN_DRAW_SQL + """
SELECT id, 'event ' || id AS title, 'score ' || CAST(round(score, 1) AS VARCHAR) AS abstract, round(score, 6) AS score FROM drawn WHERE "show" = 1
""")
def q_shown_papers(spark, sf):
    """P10: the shown rows with the columns of the display."""
    from papersift.operators.scoring import display_projection

    drawn = _main_draw(spark, sf).withColumns({"title": F.concat(F.lit("event "), "id"), "abstract": F.concat(F.lit("score "), F.round("score", 1).cast("string"))})
    return display_projection(drawn).withColumn("score", F.round("score", 6))


@register("table_size", """
SELECT count(*) AS rows, CAST(sum(length('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
  || '","o_orderpriority":"' || o_orderpriority || '"}')) AS BIGINT) AS json_chars FROM orders
""")
def q_table_size(spark, sf):
    """Rows and size of a table in one pass."""
    from papersift.operators.scoring import table_stats

    return table_stats(td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@register("keyword_map", "SELECT p_brand AS key, lower(arg_max(p_type, p_partkey)) || '|' || CAST(max(p_partkey) AS VARCHAR) AS mapped FROM part GROUP BY p_brand")
def q_keyword_map(spark, sf):
    """Of the records of a key the last one counts."""
    from papersift.operators import keywords as kw

    records = td.table(spark, sf, "part").select(
        F.col("p_brand").alias("key"), F.array(F.lower("p_type"), F.col("p_partkey").cast("string")).alias("values"), "p_partkey")
    return kw.mapping_table(records, "p_partkey").select("key", F.array_join("values", "|").alias("mapped"))


@register("vocabulary", "SELECT DISTINCT p_brand AS category, p_name AS keyword FROM part")
def q_vocabulary(spark, sf):
    """A vocabulary file (category -> keywords), written from the parts and read back."""
    from papersift.sources.vocabulary import read_vocabulary

    path = _scratch(spark, "vocabulary")
    lists = td.table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    one = lists.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "names")))).alias("value"))
    one.write.text(path)
    return read_vocabulary(spark, path)


# ---------------------------------------------------------------- scores of a given model (M3)

WEIGHTS = [((7 * k) % 11 - 5) / 4 for k in range(64)]
BIAS = 0.25


@register("score_given_model", _cte(papers=td.PAPERS_SQL) + f"""
, x AS (SELECT id, list_concat(emb_a, emb_b) AS v FROM papers WHERE emb_a IS NOT NULL AND emb_b IS NOT NULL)
SELECT id, round(1 / (1 + exp(-({BIAS} + list_sum(list_transform(range(1, 65), lambda i: CAST(v[i] AS DOUBLE) * ({WEIGHTS!r})[i])))))
  , 6) AS score FROM x
""")
def q_score_given_model(spark, sf):
    """M3 with fixed coefficients: the fitted model's ``transform`` path, compared number by number."""
    from papersift.operators.corpus import with_all_embeddings
    from papersift.operators.scoring import score
    from papersift.operators.training import given_model

    papers = with_all_embeddings(td.papers(spark, sf), list(td.EMBEDDING_COLUMNS))
    return score(given_model(spark, WEIGHTS, BIAS), papers, td.EMBEDDING_COLUMNS).select("id", F.round("score", 6).alias("score"))
