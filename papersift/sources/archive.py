"""S3 archive scan and the month read used by the upsert."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papersift.schemas import EMPTY_ARCHIVE


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def files_below(spark: SparkSession, path: str) -> Iterator[str]:
    """Names of the data files below a folder of any file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if not name.startswith((".", "_")):
            yield name


def _reader(spark: SparkSession):
    """A broken line is an error, never an all-null row."""
    return spark.read.option("mode", "FAILFAST")


def read_archive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All archived rows.  A missing folder is an empty table (``id, summary``
    or ``schema``); unreadable data is an error, not an empty table.  A versioned
    archive is read as of its newest version."""
    from papersift.sinks import versioned

    if not exists(spark, path):
        return spark.createDataFrame([], schema or EMPTY_ARCHIVE)
    if versioned.is_versioned(spark, path):
        return versioned.read(spark, path, schema)
    reader = _reader(spark)
    if schema is not None:
        full = schema if "month" in schema.fieldNames() else T.StructType(
            list(schema.fields) + [T.StructField("month", T.StringType())])
        reader = reader.schema(full)
    else:
        if not any(files_below(spark, path)):  # an existing folder without data files
            return spark.createDataFrame([], EMPTY_ARCHIVE)
        data = _reader(spark).option("recursiveFileLookup", True).json(path).schema
        if not data.fields:
            return spark.createDataFrame([], EMPTY_ARCHIVE)
        reader = reader.schema(T.StructType(data.fields + [T.StructField("month", T.StringType())]))
    return reader.json(path)


def read_months(spark: SparkSession, path: str, months: list[str], schema: T.StructType | None = None) -> DataFrame | None:
    """Rows of the listed month partitions (the month stays text: ``0704``).

    Fields of ``schema`` are read with its types; stored fields that it lacks are kept as they are."""
    dirs = [os.path.join(path, f"month={m}") for m in months]
    dirs = [d for d in dirs if exists(spark, d)]
    if not dirs:
        return None
    stored = _reader(spark).json(dirs).schema.fields  # inference over touched months only
    given = schema.fields if schema is not None else []
    names = {f.name for f in given} | {"month"}
    fields = [f for f in given if f.name != "month"] + [f for f in stored if f.name not in names]
    full = T.StructType(fields + [T.StructField("month", T.StringType())])
    return _reader(spark).schema(full).option("basePath", path).json(dirs)
