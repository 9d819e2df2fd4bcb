"""End-to-end runs with their sinks: daily recommendation (§3.1), digest of
named papers (§3.2) and ratings from a bibliography export (§3.3).

Every step is a DataFrame function; this module only wires sources, the
composed plans and the sinks together.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papersift.operators import cache as cache_ops
from papersift.operators import enrich as enrich_ops
from papersift.operators import keywords as kw
from papersift.operators import ratings
from papersift.plans.recommend import digest_named, recommend
from papersift.settings import Settings
from papersift.sinks.archive import upsert
from papersift.sinks.files import write_parquet, write_ratings_csv
from papersift.sources.bibliography import read_export

ID_ONLY = T.StructType([T.StructField("id", T.StringType())])


def summarize(
    shown: DataFrame,
    cache: DataFrame,
    fn: Callable[[dict], dict],
    fields: T.StructType,
    settings: Settings,
    run_time: str,
    provenance: dict | None = None,
    keyword_map: dict | DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cache lookup, enrichment of the misses, metadata merge and keyword rewrite.

    Returns (digests, failures)."""
    wanted_ids = shown.select("id")
    cached = cache_ops.latest_cached(cache, wanted_ids, settings.language, settings.acceptable_cache_models)
    prov = {"lang": settings.language, **(provenance or {})}
    tasks, in_flight = (None, 1) if settings.workers is None else enrich_ops.shares(
        settings.workers, shown.sparkSession.sparkContext.defaultParallelism)
    results, failed = enrich_ops.enrich(
        shown, cached, fn, fields, prov, run_time, num_partitions=tasks, in_flight=in_flight,
        required_text=settings.required_text, required_lists=settings.required_lists)
    merged = cache_ops.merge_metadata(results, shown)
    if keyword_map is not None and "keywords" in merged.columns:
        if isinstance(keyword_map, dict):
            merged = kw.rewrite_with_dict(merged, keyword_map)
        else:
            merged = kw.rewrite_with_table(merged, keyword_map)
    return merged, failed


def run_daily(
    spark: SparkSession,
    papers: DataFrame,
    preferences: DataFrame,
    archive_path: str,
    output_path: str,
    cache: DataFrame,
    fn: Callable[[dict], dict],
    fields: T.StructType,
    settings: Settings,
    today: _dt.date | None = None,
    keyword_map: dict | DataFrame | None = None,
) -> DataFrame:
    """§3.1: recommend, summarise, write the Parquet result (K1), upsert the archive (K2)."""
    from papersift.sources.archive import read_archive

    digested = read_archive(spark, archive_path, ID_ONLY)
    shown = recommend(papers, preferences, settings, digested_ids=digested, today=today)
    return _finish(spark, shown, cache, fn, fields, settings, keyword_map, output_path, archive_path)


def run_named(
    spark: SparkSession,
    papers: DataFrame,
    preferences: DataFrame,
    ids: list[str] | DataFrame,
    archive_path: str,
    output_path: str,
    cache: DataFrame,
    fn: Callable[[dict], dict],
    fields: T.StructType,
    settings: Settings,
    keyword_map: dict | DataFrame | None = None,
) -> DataFrame:
    """§3.2: score the named papers, summarise all of them, write the result and upsert the archive."""
    from papersift.sources.archive import read_archive

    digested = read_archive(spark, archive_path, ID_ONLY)
    shown = digest_named(papers, preferences, ids, settings, digested_ids=digested)
    return _finish(spark, shown, cache, fn, fields, settings, keyword_map, output_path, archive_path)


def _finish(spark, shown, cache, fn, fields, settings, keyword_map, output_path, archive_path) -> DataFrame:
    """Summaries, the Parquet result (K1) and the archive (K2); returns the failures."""
    run_time = _dt.datetime.now(_dt.timezone.utc).isoformat()
    digests, failed = summarize(shown, cache, fn, fields, settings, run_time, keyword_map=keyword_map)
    write_parquet(digests, output_path)
    out = spark.read.parquet(output_path)
    upsert(out, archive_path, order_by=["summary_time"], schema=out.schema)
    return failed


def ratings_from_export(spark: SparkSession, export_path: str, out_path: str, preference: str = "like") -> None:
    """§3.3: bibliography export -> distinct ids -> ratings CSV."""
    ids = ratings.extract_ids(read_export(spark, export_path))
    write_ratings_csv(ratings.ratings_from_ids(ids, preference), out_path)


__all__ = ["summarize", "run_daily", "run_named", "ratings_from_export"]
