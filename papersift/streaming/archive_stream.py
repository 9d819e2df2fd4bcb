"""Incremental archiving with Structured Streaming.

The batch job is rerun on new papers: digested ids are skipped (anti join) and
results are upserted by id.  As a stream, new digest files landing in a folder
are upserted into the month-partitioned archive batch by batch.  The upsert is
idempotent (replace whole rows by id), so replaying a batch after a failure
gives the same archive: ``foreachBatch`` plus the stream checkpoint make the
sink effectively exactly-once.  One stream per archive (single writer).
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from papersift.session import ensure_checkpoint_dir
from papersift.sinks.archive import upsert


def start(
    spark: SparkSession,
    landing: str,
    archive: str,
    schema: T.StructType,
    order_by: list[str] | None = None,
    checkpoint: str | None = None,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Upsert every new JSON file under ``landing`` into ``archive``.

    ``checkpoint`` defaults to a folder below spark.checkpoint.dir named by a hash of
    the archive's full path, so a restarted stream resumes where it stopped.
    """
    base = ensure_checkpoint_dir(spark)
    checkpoint = checkpoint or os.path.join(base, "streams", hashlib.sha256(archive.rstrip("/").encode()).hexdigest()[:24])
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = reader.json(landing)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, archive, order_by=order_by, schema=schema)

    writer = source.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
