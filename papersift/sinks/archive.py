"""K2: keyed, month-partitioned JSON archive upsert.

Per touched month, old rows whose id is in the new batch are replaced whole by
the new rows (no field merge); other months are not rewritten.  Layout:
``<path>/month=YYMM/part-*.json``, rows sorted by id across the part files of a
month (range partitioning: a month with a third of all rows is still split
over many tasks).

The batch is computed once, into a scratch table under ``spark.checkpoint.dir``.
This plain layout has a single writer.  With ``staging`` (the default) the merged
months are first written to a scratch table; the final overwrite then reads only
that table, so a lost executor during the overwrite never re-reads half-replaced
month folders.  An archive made by ``versioned.create`` takes several writers at
a time, and readers never see a part of an upsert; ``upsert`` finds its manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from papersift.operators.archive import archive_rows, month_summary
from papersift.session import materialize, scratch_path
from papersift.sinks import versioned
from papersift.sources.archive import read_months


def upsert(
    df: DataFrame,
    path: str,
    order_by: list[str] | None = None,
    schema: T.StructType | None = None,
    id_col: str = "id",
    staging: bool = True,
    stats: dict | None = None,
) -> list[str]:
    """Merge ``df`` into the archive at ``path``; returns the months rewritten.

    ``stats`` (if given) receives ``dropped``, the rows without content (A10),
    and ``staged``, the scratch table of the merged months when staging ran."""
    if not df.columns:
        return []  # empty frame without columns: nothing to do
    if id_col not in df.columns:
        raise ValueError("DataFrame missing 'id' column.")
    spark = df.sparkSession
    schema = schema or df.schema
    df = materialize(df, "archive-batch", columnar=True)  # computed once; read for the summary and the merge
    summary = month_summary(df, id_col)  # one row per touched month
    months = sorted(r["month"] for r in summary if r["kept"] > 0)
    if stats is not None:
        stats["dropped"] = sum(r["rows"] - r["kept"] for r in summary)
    rows = archive_rows(df, order_by, id_col)
    if not months:
        return []
    if versioned.is_versioned(spark, path):
        rows = materialize(rows, "archive-rows", columnar=True)  # read again when another writer was first
        versioned.upsert_versioned(rows, months, path, schema, id_col)
        return months
    # stored rows keep every field; fields they share with the batch are read with its types
    old = read_months(spark, path, months, schema)
    if old is not None:
        keep = old.join(rows.select(id_col), id_col, "left_anti")
        merged = rows.unionByName(keep, allowMissingColumns=True)
    else:
        merged = rows
    # Staging matters only when the job reads the folders it overwrites.
    if staging and old is not None:
        stage = scratch_path(spark, "archive-stage")
        merged.write.mode("overwrite").parquet(stage)
        merged = spark.read.parquet(stage)
        if stats is not None:
            stats["staged"] = stage
    write_months(merged, path, id_col)
    return months


def write_months(merged: DataFrame, path: str, id_col: str = "id") -> None:
    """The final write of an upsert: the merged rows of the touched months replace
    those month folders (dynamic partition overwrite), rows in id order.

    Rerunning it on a staged table (``stats["staged"]``) completes an upsert
    whose commit was interrupted."""
    (
        merged.repartitionByRange("month", id_col)  # the shuffle's size sets the number of files
        .sortWithinPartitions("month", id_col)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", "false")
        .partitionBy("month")
        .json(path)
    )
