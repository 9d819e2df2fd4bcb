"""K2 for several writers at a time: immutable data folders and a versioned manifest.

Layout: ``<path>/data/commit=<id>/month=YYMM/part-*.json`` holds the merged months of one upsert and is never changed.
``<path>/_manifest/<version>.json`` says which commit holds each month.  A version is published in one step that fails
when another writer has published it first (a hard link on a local file system, a rename without overwrite elsewhere).
The loser reads the new manifest: if nobody touched its months, the files it wrote are published as they are under the
next version; else the months are merged again.  So no upsert is lost, and a reader, who lists one manifest, sees all of
an upsert or nothing of it.  A writer that dies leaves only a folder that no manifest names.

The manifest has one entry per month.  File systems without an atomic rename that refuses to overwrite (plain object
stores) are not covered.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from papersift.schemas import EMPTY_ARCHIVE

MANIFEST, DATA = "_manifest", "data"
#: Tries of one upsert against other writers.
ATTEMPTS = 50


class Conflict(Exception):
    """Another writer has published the version."""


@dataclass
class Manifest:
    version: int = -1
    months: dict[str, str] = field(default_factory=dict)  # month -> commit
    schema: T.StructType = field(default_factory=T.StructType)

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "months": self.months, "schema": self.schema.jsonValue()})

    @staticmethod
    def of(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], d["months"], T.StructType.fromJson(d["schema"]))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_versioned(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, os.path.join(path, MANIFEST))
    return fs.exists(p)


def _publish(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with its whole content at once; Conflict when it is there already."""
    target, fs = _hadoop(spark, path)
    folder = target.getParent()
    fs.mkdirs(folder)
    draft = f".{target.getName()}-{uuid.uuid4().hex}"
    if fs.getScheme() == "file":
        local = folder.toUri().getPath()
        draft = os.path.join(local, draft)
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, os.path.join(local, target.getName()))
        except FileExistsError:
            raise Conflict(path) from None
        finally:
            os.unlink(draft)
        return
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(folder, draft)
    out = fs.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(source, False)
        if "FileAlreadyExistsException" in str(e):
            raise Conflict(path) from None
        raise


def _file_of(path: str, version: int) -> str:
    return os.path.join(path, MANIFEST, f"{version:012d}.json")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions that are still kept, in order."""
    p, fs = _hadoop(spark, os.path.join(path, MANIFEST))
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit() and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """A version's manifest; the newest by default, and an empty one where there is none."""
    if version is None:
        version = max(versions(spark, path), default=-1)
    if version < 0:
        return Manifest()
    p, fs = _hadoop(spark, _file_of(path, version))
    stream = fs.open(p)
    try:
        return Manifest.of(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def create(spark: SparkSession, path: str) -> None:
    """Make ``path`` a versioned archive: ``upsert``, ``read_archive`` and the stream sink then use its manifest.
    A folder with data in the plain layout is refused."""
    from papersift.sources.archive import exists, files_below

    if is_versioned(spark, path):
        return
    if exists(spark, path) and any(files_below(spark, path)):
        raise ValueError(f"{path} holds a plain archive")
    try:
        _publish(spark, _file_of(path, 0), Manifest(0).to_json())
    except Conflict:
        pass  # another writer made it


def _rows(spark: SparkSession, path: str, folders: dict[str, str], schema: T.StructType) -> DataFrame:
    full = T.StructType([*[f for f in schema.fields if f.name != "month"], T.StructField("month", T.StringType()), T.StructField("commit", T.StringType())])
    data = os.path.join(path, DATA)
    dirs = [os.path.join(data, f"commit={c}", f"month={m}") for m, c in sorted(folders.items())]
    return spark.read.option("mode", "FAILFAST").schema(full).option("basePath", data).json(dirs).drop("commit")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, version: int | None = None) -> DataFrame:
    """All rows of one version, by default the newest, with ``month``; later upserts don't change the frame."""
    own = manifest(spark, path, version)
    wanted = schema or (own.schema if own.schema.fields else EMPTY_ARCHIVE)
    if not own.months:
        return spark.createDataFrame([], wanted)
    return _rows(spark, path, own.months, wanted)


def _merged_schema(given: T.StructType, stored: T.StructType) -> T.StructType:
    names = {f.name for f in given.fields} | {"month"}
    return T.StructType([f for f in given.fields if f.name != "month"] + [f for f in stored.fields if f.name not in names])


def upsert_versioned(rows: DataFrame, months: list[str], path: str, schema: T.StructType, id_col: str = "id", attempts: int = ATTEMPTS) -> int:
    """Publish ``rows`` (with ``month``, one per id, stored) over the archive; returns the version."""
    from papersift.sinks.archive import write_months

    spark = rows.sparkSession
    base = commit = None
    for attempt in range(attempts):
        now = manifest(spark, path)
        if base is None or any(base.months.get(m) != now.months.get(m) for m in months):
            base, commit = now, uuid.uuid4().hex
            old = {m: now.months[m] for m in months if m in now.months}
            merged = rows
            if old:
                kept = _rows(spark, path, old, _merged_schema(schema, now.schema)).join(rows.select(id_col), id_col, "left_anti")
                merged = rows.unionByName(kept, allowMissingColumns=True)
            write_months(merged, os.path.join(path, DATA, f"commit={commit}"), id_col)
        new = Manifest(now.version + 1, {**now.months, **dict.fromkeys(months, commit)}, _merged_schema(schema, now.schema))
        try:
            _publish(spark, _file_of(path, new.version), new.to_json())
            return new.version
        except Conflict:
            time.sleep(random.uniform(0, 0.05 * min(attempt + 1, 20)))
    raise Conflict(f"{path}: other writers were first {attempts} times")


def clean(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Forget all but the ``keep`` newest versions, and delete the folders that only those had; returns their number.
    Readers of a forgotten version fail; unpublished folders of running writers stay."""
    known = versions(spark, path)
    gone, left = known[:-keep], known[-keep:]
    used = {c for v in left for c in manifest(spark, path, v).months.values()}
    dropped = {c for v in gone for c in manifest(spark, path, v).months.values()} - used
    for v in gone:
        p, fs = _hadoop(spark, _file_of(path, v))
        fs.delete(p, False)
    for c in sorted(dropped):
        p, fs = _hadoop(spark, os.path.join(path, DATA, f"commit={c}"))
        fs.delete(p, True)
    return len(dropped)


__all__ = ["Conflict", "Manifest", "clean", "create", "is_versioned", "manifest", "read", "upsert_versioned", "versions"]
