"""Ratings CSV files below a folder (``id, preference`` as text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papersift.schemas import PREFERENCES
from papersift.sources.archive import exists, files_below


def normalized_id(col: str = "id"):
    """A four-digit month, a dot and fewer than five digits is padded with zeros to
    five (``2410.1285`` -> ``2410.12850``); other ids are kept as they are."""
    c = F.col(col)
    short = c.rlike(r"^\d{4}\.\d{1,4}$")
    padded = F.concat(F.substring_index(c, ".", 1), F.lit("."), F.rpad(F.substring_index(c, ".", -1), 5, "0"))
    return F.when(short, padded).otherwise(c)


def read_preferences(spark: SparkSession, folder: str, normalize_ids: bool = False) -> DataFrame:
    """Every ``*.csv`` below ``folder`` (recursive).  Ids stay text, so ``2406.1``
    and ``2406.10`` are different ids (exact matching, the default); with
    ``normalize_ids`` short fractions are padded to five digits first, repairing
    ids that lost trailing zeros.  ``source_file`` feeds the dedupe (D1)."""
    if not exists(spark, folder):
        raise FileNotFoundError(f"preference folder not found: {folder}")
    if not any(name.endswith(".csv") for name in files_below(spark, folder)):
        raise FileNotFoundError(f"no rating file below {folder}")
    df = (
        spark.read.schema(PREFERENCES)
        .option("header", True)
        .option("enforceSchema", False)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    ident = normalized_id("id") if normalize_ids else F.col("id")
    return df.select(ident.alias("id"), "preference", F.col("_metadata.file_path").alias("source_file"))
