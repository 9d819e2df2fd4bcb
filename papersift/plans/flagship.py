"""The flagship query: daily recommendation over the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.plans import testdata as td
from papersift.plans.recommend import recommend
from papersift.session import ensure_checkpoint_dir
from papersift.settings import Settings

# The test data has fewer unrated rows than five per like and too few rows for a
# 0.004 rate to mean anything, so the flagship uses one negative per like and a
# 0.1 rate.  Categories are the adapter's languages.
FLAGSHIP_SETTINGS = Settings(
    categories=("en", "de", "fr", "es"),
    embedding_columns=td.EMBEDDING_COLUMNS,
    background_start_year=2024,
    preference_start_year=2023,
    bg_sample_rate=1.0,
    sample_rate=0.1,
    start_date="2024-01-01",
    end_date="2024-12-31",
)


def recommend_on_testdata(spark: SparkSession, sf_dir: str, settings: Settings = FLAGSHIP_SETTINGS) -> DataFrame:
    ensure_checkpoint_dir(spark)
    shown = recommend(td.papers(spark, sf_dir), td.preferences(spark, sf_dir), settings)
    return shown.select("id", "title", "updated", F.round("score", 6).alias("score"), "show")
