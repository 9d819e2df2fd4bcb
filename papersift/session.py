"""Session helpers.

Library code never invents storage locations: scratch data goes below the
folder named by ``spark.checkpoint.dir`` (shared storage on a cluster).  Only
``local_session`` (tests, bench) fills that setting in, and only when unset.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "papersift") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast only what is measured or checked: no broadcast from static size
        # estimates; AQE may still switch a join at run time from the measured
        # shuffle size, and the library's own broadcasts sit behind a row-count check.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared scratch folder.  Only a local session (tests, bench) gets one of its own when
    none is set; on a cluster, where executors don't share the driver's disk, that is an error."""
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; point it at storage that all executors share")
        current = tempfile.mkdtemp(prefix="papersift-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder (never machine-local on a cluster)."""
    base = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage before writing scratch tables"
        )
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str, columnar: bool = False, key: str | None = None):
    """Compute ``df`` once and cut its lineage (data under spark.checkpoint.dir,
    shared storage on a cluster); a lost executor re-reads it instead of
    replaying the plan.  ``name`` labels the job.

    Default: reliable checkpoint of the persisted frame (persisting first avoids
    computing it twice; partitioning is kept).  ``columnar``: a Parquet table,
    so later readers load only the columns they use; when the read-back has fewer
    partitions than cores (a small table), it is spread again by ``key``.
    """
    from pyspark import StorageLevel

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    spark.sparkContext.setJobDescription(f"materialize {name}")
    try:
        if columnar:
            path = scratch_path(spark, name)
            df.write.mode("overwrite").parquet(path)
            out = spark.read.parquet(path)
            return spread(out, key) if key else out
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out
    finally:
        spark.sparkContext.setJobDescription(None)


# Below this estimated size an input is spread over all cores before heavy
# per-row work (64 MiB: well under one file split, so the shuffle is cheap).
SPREAD_MAX_BYTES = 64 * 1024 * 1024


def estimated_bytes(df) -> int:
    """The optimizer's size estimate of ``df`` (planning only, nothing runs)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df, key: str):
    """Hash-partition a small ``df`` by ``key`` over all cores.

    Small inputs often arrive as one file split, which would put all later
    per-row work on one core; large inputs keep their natural splits and are
    never reshuffled here.  The decision uses the plan's size estimate, so
    nothing is executed to make it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) <= SPREAD_MAX_BYTES:
        return df.repartition(cores, key)
    return df


#: Rows and bytes of one Arrow batch between the JVM and Python; whole texts travel in them.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
