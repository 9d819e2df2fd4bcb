"""Keyword vocabulary, a JSON object of category -> keyword list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One row per (category, keyword)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", "map<string,array<string>>")
    return (
        raw.select(F.explode(m).alias("category", "keywords"))
        .select("category", F.explode("keywords").alias("keyword"))
    )
