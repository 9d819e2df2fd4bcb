"""A bounded sample of labelled documents that a model may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.llm.common import held_out, stored, texts_of

#: Labelled rows that a model learns from, in the mean; the bound of every fit.
MOST_ROWS = 24_000
_GRID = 1 << 30


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MOST_ROWS) -> DataFrame:
    """``text`` and ``y`` of about ``most`` labelled rows, none of them held out, as a stored table.

    A row is taken by a hash of its id, so the choice doesn't depend on partitions or retries.  Repeated label rows
    of a document count once (their largest label), null labels and ids never.  The chosen ids are bounded by
    ``most``, which is what makes their broadcast safe; the documents themselves are not shuffled.
    """
    own = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where(~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    count = max(1, own.count())
    share = min(_GRID, int(_GRID * most / count) + 1)
    chosen = own.where(F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(_GRID)) < share)
    return stored(texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"), f"labelled-{label}")
