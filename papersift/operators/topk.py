"""Exact k smallest rows by (key, tie), without pulling the rows anywhere.

``kth_cutoff`` returns the (key, tie) pair of the k-th smallest row.  A row is
then selected by a plain predicate, ``(key, tie) <= cutoff``, so the draw is a
projection over the whole table: no join back, no window over a stratum (which
would put a whole stratum into one task).

Histogram narrowing, for any k: each round counts the rows of the open range per
bucket (a partial+final aggregate of at most ``buckets`` groups), keeps every
bucket below the one holding the k-th row, and goes into that bucket until
it holds at most ``exact_limit`` rows, a few thousand, which are then sorted.
Content-hash keys are uniform, so one or two rounds are enough.

``stratified_cutoffs`` does this for all strata of a draw together: one aggregate
counts every stratum's rows by bucket of a position in [0, 1), which gives the
strata's sizes and the bucket of each cutoff; a second scan fetches those buckets'
rows.  Only buckets of more than ``exact_limit`` rows take a further scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the last open bucket, which one task sorts.
EXACT_LIMIT = 4096
BUCKETS = 4096
#: Buckets of each stratum in the first scan of ``stratified_cutoffs``.
STRATUM_BUCKETS = 16384


def before_or_at(key: Column, tie: Column, cutoff: tuple) -> Column:
    ck, ct = cutoff
    return (key < F.lit(ck)) | ((key == F.lit(ck)) & (tie <= F.lit(ct)))


def _max_pair(df: DataFrame, key: str, tie: str):
    row = df.agg(F.max(F.struct(F.col(key).alias("k"), F.col(tie).alias("t"))).alias("m")).first()
    m = row["m"] if row else None
    return None if m is None else (m["k"], m["t"])


def kth_cutoff(
    df: DataFrame,
    key: Column,
    tie: Column,
    k: int,
    exact_limit: int = EXACT_LIMIT,
    buckets: int = BUCKETS,
):
    """(key, tie) of the k-th smallest row (the largest row when fewer than k
    exist); None when k <= 0 or df is empty."""
    return cutoff_and_count(df, key, tie, k, exact_limit, buckets)[0]


def cutoff_and_count(
    df: DataFrame,
    key: Column,
    tie: Column,
    k: int,
    exact_limit: int = EXACT_LIMIT,
    buckets: int = BUCKETS,
):
    """``(cutoff, m)``: the cutoff of ``kth_cutoff`` and ``m = min(k, rows)``.

    Raises when more than k rows are at or before the cutoff: then an id is repeated
    there, and no predicate on (key, id) can draw exactly k rows."""
    if k <= 0:
        return None, 0
    return _narrow(df.select(key.alias("_k"), tie.alias("_t")), k, exact_limit, buckets)


def _narrow(base: DataFrame, k: int, exact_limit: int, buckets: int):
    """Histogram narrowing (see the module docstring)."""
    cond = F.lit(True)
    need = k
    first = True
    total = 0
    while True:
        part = base.where(cond)
        stats = part.agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.count(F.lit(1)).alias("n")).first()
        n, lo, hi = stats["n"], stats["lo"], stats["hi"]
        if first:
            total, first = n, False
        if n == 0:
            return None, 0
        if need >= n:
            return _max_pair(part, "_k", "_t"), min(k, total)
        if n <= exact_limit or lo == hi or not math.isfinite(hi - lo):
            # lo == hi: every open row has the same key (only repeated ids share
            # a content-hash key), so the tie column decides among them.
            if n > exact_limit:
                raise ValueError(f"{n} rows share the key at the cutoff of the draw; ids must be unique")
            cutoff = _max_pair(part.orderBy("_k", "_t").limit(need), "_k", "_t")
            if part.where(before_or_at(F.col("_k"), F.col("_t"), cutoff)).count() > need:
                raise ValueError(f"id {cutoff[1]!r} is repeated at the cutoff of the draw; ids must be unique")
            return cutoff, k
        width = (hi - lo) / buckets
        bucket = F.least(F.floor((F.col("_k") - F.lit(lo)) / F.lit(width)), F.lit(buckets - 1)).cast("int")
        counts = sorted(
            (r["b"], r["c"]) for r in part.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        )
        below = 0
        for b, c in counts:
            if below + c >= need:
                need -= below
                cond = cond & (bucket == F.lit(b))
                break
            below += c


def stratified_cutoffs(
    df: DataFrame,
    stratum: Column,
    key: Column,
    position: Column,
    tie: Column,
    wanted: Callable[[dict[str, int]], dict[str, int]],
    exact_limit: int = EXACT_LIMIT,
    buckets: int = STRATUM_BUCKETS,
) -> tuple[dict[str, int], dict[str, tuple | None]]:
    """``(sizes, cutoffs)`` of all strata at once.

    ``position`` is in [0, 1) and never falls where ``key`` grows.  ``wanted`` says, from the strata's sizes, how many
    rows each gives.  ``cutoffs`` has the (key, tie) of the last row of each stratum that gives some but not all of its
    rows; strata that give none or all have no entry.  Raises when more rows than wanted are at or before a cutoff.
    ``buckets`` is a power of two, so that the borders of buckets are exact."""
    if buckets < 2 or buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    base = df.select(stratum.alias("_g"), key.alias("_k"), position.alias("_p"), tie.alias("_t"))

    def histogram(open_ranges: dict[str, tuple[float, float]], rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        """Rows of each stratum's open range by bucket: one scan."""
        bucket = F.lit(None).cast("int")
        for g, (lo, hi) in open_ranges.items():
            b = F.least(F.floor((F.col("_p") - F.lit(lo)) / F.lit((hi - lo) / buckets)), F.lit(buckets - 1)).cast("int")
            bucket = F.when(F.col("_g") == g, b).otherwise(bucket)
        if not open_ranges:
            bucket = F.least(F.floor(F.col("_p") * buckets), F.lit(buckets - 1)).cast("int")
        out: dict[str, list[tuple[int, int]]] = {}
        for r in rows.groupBy("_g", bucket.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect():
            out.setdefault(r["_g"], []).append((r["b"], r["c"]))
        return {g: sorted(v) for g, v in out.items()}

    def inside(ranges: dict[str, tuple[float, float]]) -> Column:
        parts = [(F.col("_g") == g) & (F.col("_p") >= lo) & (F.col("_p") < hi) for g, (lo, hi) in ranges.items()]
        return reduce(lambda a, b: a | b, parts)

    counted = histogram({}, base)
    sizes = {g: sum(c for _, c in v) for g, v in counted.items()}
    need = {g: k for g, k in wanted(sizes).items() if 0 < k < sizes.get(g, 0)}
    ranges = {g: (0.0, 1.0) for g in need}
    final: dict[str, tuple[float, float]] = {}
    while need.keys() - final.keys():
        for g in need.keys() - final.keys():
            lo, hi = ranges[g]
            width = (hi - lo) / buckets
            for b, c in counted[g]:
                if c >= need[g]:
                    ranges[g] = (lo + width * b, lo + width * (b + 1))
                    if c <= exact_limit:
                        final[g] = ranges[g]
                    elif not ranges[g][0] + (ranges[g][1] - ranges[g][0]) / buckets > ranges[g][0]:
                        raise ValueError(f"{c} rows of stratum {g!r} share the key at the cutoff of the draw; ids must be unique")
                    break
                need[g] -= c
        still = {g: r for g, r in ranges.items() if g not in final}
        if still:
            counted = histogram(still, base.where(inside(still)))
    if not final:
        return sizes, {}
    rows: dict[str, list[tuple]] = {}
    for r in base.where(inside(final)).select("_g", "_k", "_t").collect():  # at most exact_limit rows of each stratum
        rows.setdefault(r["_g"], []).append((r["_k"], r["_t"]))
    cutoffs: dict[str, tuple | None] = {}
    for g, own in rows.items():
        own.sort()
        cutoffs[g] = own[need[g] - 1]
        if len(own) > need[g] and own[need[g]] == cutoffs[g]:
            raise ValueError(f"id {cutoffs[g][1]!r} is repeated at the cutoff of the draw; ids must be unique")
    return sizes, cutoffs
