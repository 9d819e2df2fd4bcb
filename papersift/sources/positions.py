"""Late materialisation (P17, J1): rows are chosen on thin columns, their wide ones are read afterwards by position.

``with_positions`` adds to a Parquet scan where each row lies: its file and its place in the file.  Choosing rows (joins,
draws) then needs the thin columns only.  ``fetch`` reads the wide columns from the files that hold a chosen row, and from
no other, and matches rows by position, so no key is read again and repeated keys stay apart.  The driver holds the
names of those files, as it does for the listing of any scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE, ROW = "_file", "_row"


def with_positions(scan: DataFrame) -> DataFrame:
    """A Parquet scan (not yet joined or grouped) with the position of each row."""
    return scan.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def has_positions(df: DataFrame) -> bool:
    return {FILE, ROW} <= set(df.columns)


def fetch(chosen: DataFrame, wide: T.StructType) -> DataFrame:
    """``chosen`` (with positions) and the columns ``wide`` of its rows; a column that a file lacks is null."""
    spark = chosen.sparkSession
    files = sorted(r[FILE] for r in chosen.select(FILE).distinct().collect())
    own = [c for c in chosen.columns if c not in (FILE, ROW)]
    if not files:
        return chosen.select(*own, *[F.lit(None).cast(f.dataType).alias(f.name) for f in wide.fields])
    rows = with_positions(spark.read.schema(wide).parquet(*files))
    return chosen.join(rows, [FILE, ROW]).select(*own, *wide.fieldNames())
