"""Bibliography export (quoted CSV, line breaks and doubled quotes inside
fields, UTF-8 with a byte-order mark); every column is text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )
