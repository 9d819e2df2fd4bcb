"""K1 Parquet result and K3 ratings CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str) -> None:
    """K1 (an empty result still writes its schema)."""
    df.write.mode("overwrite").parquet(path)


def write_ratings_csv(ratings: DataFrame, path: str) -> None:
    """K3: header, ids ascending.  ``orderBy`` range-partitions, so part files are
    in id order without funnelling all rows through one task."""
    ratings.select("id", "preference").orderBy("id").write.mode("overwrite").option("header", True).csv(path)
