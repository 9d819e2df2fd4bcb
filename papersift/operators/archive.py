"""Archive row preparation: P13 P14 D3 (the write itself is ``sinks.archive``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.functions.text import any_of, has_text
from papersift.operators.dedup import latest_per_key


def meaningful(df: DataFrame, id_col: str = "id") -> Column:
    """Some non-id column is non-null and, for strings, not blank."""
    conds = []
    for f in df.schema.fields:
        if f.name == id_col:
            continue
        c = F.col(f"`{f.name}`")
        conds.append(F.coalesce(has_text(c), F.lit(False)) if isinstance(f.dataType, T.StringType) else c.isNotNull())
    return any_of(conds)


def month_of(id_col: str = "id") -> Column:
    """The month key is the first four characters of the id."""
    return F.substring(F.col(id_col), 1, 4)


def _has_id(id_col: str) -> Column:
    return F.when(F.col(id_col).isNull(), F.raise_error(F.lit("null id in the archive batch"))).otherwise(F.lit(True))


def month_summary(df: DataFrame, id_col: str = "id") -> list:
    """Per month of the batch: rows and rows with content (A10: the
    difference is what the meaningful-row filter drops).  One grouped pass whose
    result is as long as the number of months touched.  A null id raises."""
    rows = df.where(_has_id(id_col))
    others = [c for c in df.columns if c != id_col]
    keep = meaningful(rows, id_col) if others else F.lit(True)
    return rows.groupBy(month_of(id_col).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(keep).alias("kept")).collect()


def archive_rows(df: DataFrame, order_by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Rows ready for the archive: meaningful, one per id (last by ``order_by``), with ``month``.

    No ``id`` column raises, and so does a null id (when the rows are computed).  Without
    ``order_by`` the batch is deduplicated by ``summary_time`` when present.
    """
    if id_col not in df.columns:
        raise ValueError("DataFrame missing 'id' column.")
    df = df.where(_has_id(id_col))
    others = [c for c in df.columns if c != id_col]
    if others:
        df = df.where(meaningful(df, id_col))
        order = order_by or (["summary_time"] if "summary_time" in df.columns else None)
        if order is None:
            raise ValueError("pass order_by to say which row of a duplicated id is the last one")
        df = latest_per_key(df, id_col, list(order))
    else:
        df = df.distinct()
    return df.withColumn("month", month_of(id_col))
