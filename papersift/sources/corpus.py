"""S1 year-partitioned paper scan and S7 Parquet read-back."""

from __future__ import annotations

import datetime as _dt
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.operators.corpus import effective_start_year
from papersift.sources.archive import exists


def years_to_scan(background_start_year: int, preference_start_year: int,
                  override: int | None = None, current_year: int | None = None) -> list[int]:
    """Years from the effective start year to the current year; none if the start is in the future."""
    start = effective_start_year(background_start_year, preference_start_year, override)
    cur = current_year if current_year is not None else _dt.date.today().year
    return list(range(start, cur + 1)) if start <= cur else []


def scan_papers(spark: SparkSession, root: str, years: list[int], layout: str = "files") -> DataFrame | None:
    """Read the yearly Parquet files as one table; columns missing in some years are null.

    ``layout="files"``: ``<root>/<year>.parquet``; ``layout="partitions"``: ``<root>/year=<year>/`` (``year`` is then a
    column, and a year without a folder has no rows).  A year has one schema, read from a single footer; the years'
    schemas are united by name, so only the wanted years are opened and no footers are merged.
    Returns None when there is no year to read.
    """
    if not years:
        return None
    if layout == "partitions":
        folders = [(y, os.path.join(root, f"year={y}")) for y in years]
        tables = [spark.read.parquet(p).withColumn("year", F.lit(y)) for y, p in folders if exists(spark, p)]
    else:
        tables = [spark.read.parquet(os.path.join(root, f"{y}.parquet")) for y in years]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return spark.read.parquet(path)
