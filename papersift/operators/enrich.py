"""Cache-aware enrichment: E1-E6.

The per-paper function is the user's (in the original job, a call to an
external model).  It runs inside ``mapInPandas`` tasks, and a lost executor only
re-runs its own partitions.  Such calls wait, so a task keeps a bounded window of
them in flight: no row is read before a place is free, results keep the order of
the rows, and a failing row becomes an error row while the others go on.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papersift.operators import cache as cache_ops
from papersift.session import bounded_batches, materialize


def _result_schema(fields: T.StructType, id_col: str) -> T.StructType:
    names = {f.name for f in fields.fields}
    extra = [T.StructField(id_col, T.StringType())] if id_col not in names else []
    extra.append(T.StructField("error", T.StringType()))
    return T.StructType(extra + list(fields.fields))


def in_window(items: Iterable, call: Callable, size: int) -> Iterator:
    """``call`` of every item, in order, with at most ``size`` calls in flight or waiting to be taken."""
    if size <= 1:
        yield from map(call, items)
        return
    with ThreadPoolExecutor(size) as pool:
        window: deque = deque()
        try:
            for item in items:
                if len(window) == size:
                    yield window.popleft().result()
                window.append(pool.submit(call, item))
            while window:
                yield window.popleft().result()
        finally:
            for waiting in window:
                waiting.cancel()


def shares(workers: int, tasks: int) -> tuple[int, int]:
    """(tasks, calls in flight of each) so that at most ``workers`` calls overlap in all."""
    tasks = max(1, min(tasks, workers))
    return tasks, max(1, workers // tasks)


#: Results that are sent on together, and rows of a batch that are Python objects at a time.
RESULT_ROWS, RECORD_ROWS = 256, 64


def records(batches: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """The rows as dicts, a few at a time: besides a batch, no second copy of all its texts is held."""
    for pdf in batches:
        for k in range(0, len(pdf), RECORD_ROWS):
            yield from pdf.iloc[k : k + RECORD_ROWS].to_dict("records")


def apply_per_row(
    df: DataFrame,
    fn: Callable[[dict], dict],
    fields: T.StructType,
    id_col: str = "id",
    num_partitions: int | None = None,
    in_flight: int = 1,
) -> DataFrame:
    """Run ``fn(row_dict) -> dict`` on each row; failures give ``error``.

    Each task has at most ``in_flight`` calls of ``fn``, in threads, at a time; with ``num_partitions``, all tasks
    together have at most ``num_partitions * in_flight``.  Batches of rows are bounded in rows and bytes, so a worker's
    memory doesn't grow with the table."""
    bounded_batches(df.sparkSession)
    schema = _result_schema(fields, id_col)
    names = schema.fieldNames()

    def safe(rec: dict) -> dict:
        try:
            res = dict(fn(rec))
            res.setdefault(id_col, rec.get(id_col))
            res["error"] = None
        except Exception as exc:  # noqa: BLE001 - a failed row must not stop the others
            res = {id_col: rec.get(id_col), "error": f"{type(exc).__name__}: {exc}"}
        return {n: res.get(n) for n in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for res in in_window(records(batches), safe, in_flight):
            out.append(res)
            if len(out) == RESULT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    src = df if num_partitions is None else df.repartition(num_partitions)
    return src.mapInPandas(run, schema)


def enrich(
    wanted: DataFrame,
    cached: DataFrame,
    fn: Callable[[dict], dict],
    fields: T.StructType,
    provenance: dict,
    run_time: str,
    id_col: str = "id",
    num_partitions: int | None = None,
    in_flight: int = 1,
    required_text: tuple[str, ...] = (),
    required_lists: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Enrich only the cache misses, stamp provenance, add the cached rows.

    Returns ``(results, failures)``: results are fresh successes plus cached
    rows (cached wins per id); failures are ``{id, error, summary_time}``.
    A record that lacks a required field (E4) is a failure.
    Acts once: the function's output is checkpointed before the split, and an id that ``wanted`` repeats is one row.
    """
    todo = cache_ops.misses(wanted, cached, id_col).dropDuplicates([id_col])
    # The per-paper function is the expensive, external step: run it exactly once.
    # Results and failures are both read from this checkpoint (spark.checkpoint.dir),
    # so neither consumer re-runs the function, nor does a later lost executor.
    raw = materialize(apply_per_row(todo, fn, fields, id_col, num_partitions, in_flight), "enriched")
    stamped = raw.withColumn("error", F.coalesce("error", missing_fields([*required_text, *required_lists])))
    for k, v in provenance.items():  # E3
        stamped = stamped.withColumn(k, F.lit(v))
    stamped = stamped.withColumn("preference", F.lit("unknown")).withColumn("summary_time", F.lit(run_time))
    ok = stamped.where(F.col("error").isNull()).drop("error")  # P16
    failed = stamped.where(F.col("error").isNotNull()).select(id_col, "error", "summary_time")
    return ok.unionByName(cached, allowMissingColumns=True), failed  # the misses hold no cached id


def missing_fields(names: list[str]):
    """E4 as an error text: the required fields that are null, or null when none is."""
    missing = [F.when(F.col(f"`{n}`").isNull(), F.lit(n)) for n in names]
    text = F.concat_ws(",", *missing) if missing else F.lit("")
    return F.when(text != "", F.concat(F.lit("missing fields: "), text))


def required_fields_ok(df: DataFrame, text_fields: list[str], list_fields: list[str]) -> DataFrame:
    """Every required text and list field is present."""
    cond = F.lit(True)
    for c in text_fields + list_fields:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


# Required fields of a digest record (E4): seven text fields and two lists.
DIGEST_TEXT_FIELDS = [
    "reasoning_step", "problem_background", "method", "experiment",
    "one_sentence_summary", "slug", "further_thoughts",
]
DIGEST_LIST_FIELDS = ["institution", "keywords"]
DIGEST_SCHEMA = T.StructType(
    [T.StructField("institution", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in DIGEST_TEXT_FIELDS[:5]]
    + [T.StructField("slug", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())),
       T.StructField("further_thoughts", T.StringType())]
)


# Kinds of error in the side table.
NO_TEXT, NOT_JSON, MISSING = "no text", "malformed", "missing fields"


def route_digests(df: DataFrame, text_col: str, id_col: str = "id", schema: T.StructType = DIGEST_SCHEMA,
                  required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """F12 + F13 + E2 + E4 in one pass: (records, errors) of the model's texts.

    Each text is parsed once, into a table that both results read.  ``records`` has ``id`` and the fields of ``schema``;
    ``errors`` has ``id, kind, fields, text``: there was no text, it is no such record (``text`` holds it), or the
    ``required`` fields (all of ``schema`` by default) named in ``fields`` are null."""
    from papersift.functions.text import has_text, strip_code_fence

    corrupt = "_corrupt"
    required = schema.fieldNames() if required is None else required
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(strip_code_fence(text_col), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = df.select(F.col(id_col), F.col(text_col).alias("text"), parsed.alias("rec"))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"rec.`{n}`").isNull(), F.lit(n)) for n in required]).cast("array<string>"))
    blank = ~F.coalesce(has_text(F.col("text")), F.lit(False))
    bad = F.col("rec").isNull() | F.col(f"rec.{corrupt}").isNotNull()
    kind = F.when(blank, F.lit(NO_TEXT)).when(bad, F.lit(NOT_JSON)).when(F.size(lacking) > 0, F.lit(MISSING))
    routed = materialize(rows.select(id_col, "rec", kind.alias("kind"), lacking.alias("fields"), "text"), "digests", columnar=True)
    records = routed.where("kind IS NULL").select(id_col, *[F.col(f"rec.`{f.name}`").alias(f.name) for f in schema.fields])
    errors = routed.where("kind IS NOT NULL").select(
        id_col, "kind", F.when(F.col("kind") == MISSING, F.col("fields")).alias("fields"),
        F.when(F.col("kind") == NOT_JSON, F.col("text")).alias("text"))
    return records, errors


def parse_digest(df: DataFrame, text_col: str, schema: T.StructType = DIGEST_SCHEMA) -> DataFrame:
    """F12 + F13 + E4: model text to a record; rows missing a required field
    get ``error`` set instead of failing the job."""
    from papersift.functions.text import strip_code_fence

    parsed = F.from_json(strip_code_fence(text_col), schema, {"mode": "PERMISSIVE"})
    out = df.withColumn("__rec", parsed)
    missing = [F.when(F.col("__rec").isNull() | F.col(f"__rec.{f.name}").isNull(), F.lit(f.name))
               for f in schema.fields]
    err = F.concat_ws(",", *missing)
    return out.select(
        *[c for c in df.columns if c != text_col],
        *[F.col(f"__rec.{f.name}").alias(f.name) for f in schema.fields],
        F.when(err != "", F.concat(F.lit("missing fields: "), err)).alias("error"),
    )
