"""Cache scan pruned by key prefix.

The cache is laid out as ``<root>/month=YYMM/*.json``.  Only the months of the
wanted ids are read: their prefixes (D7) are joined with the partition column, so
the scan is pruned while it runs (``dynamicpruning`` among its ``PartitionFilters``)
and nothing is collected to plan it.  A missing root gives an empty table of
``schema``, and ids without a usable prefix have no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.operators.dedup import key_prefixes
from papersift.sources.archive import exists


def read_cache(spark: SparkSession, root: str, wanted_ids: DataFrame, schema: T.StructType,
               id_col: str = "id") -> DataFrame:
    full = T.StructType([f for f in schema.fields if f.name != "month"] + [T.StructField("month", T.StringType())])
    if not exists(spark, root):
        return spark.createDataFrame([], full)
    months = key_prefixes(wanted_ids, id_col)  # distinct texts of four digits: 10,000 rows at most, so broadcast
    return spark.read.schema(full).json(root).join(F.broadcast(months), "month", "left_semi").select(full.fieldNames())
