"""A global rank without a single-task sort (T2, T3 as a checkable order).

Rows are range partitioned and sorted, and stored with their partition and place.  The partitions' row counts, one row
each, give every partition its offset; a row's rank is its offset plus its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papersift.session import materialize

#: Bits of a row's place in monotonically_increasing_id.
_PLACE = 33


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the 1-based place of each row in ``order`` (ties in no particular order)."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(dealt, "ranked", columnar=True)
    part = F.shiftright("__at", _PLACE).alias("__part")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PLACE) - 1))
    ranked = rows.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return ranked.select(*df.columns, (F.col("__before") + place + 1).alias(name))
