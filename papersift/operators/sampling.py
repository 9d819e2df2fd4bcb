"""Deterministic sampling: pseudo-negative draw (R1) and the quota draw.

All draws use content-hash keys (``papersift.functions.hashing``), so the chosen
rows do not change with partitioning, retries or lost executors.  Each draw is
salted with its own purpose, so the pseudo-negative draw and the later quota
draw over the same table are independent.

The quota draw, as one rule over three strata (high: score >= high;
boundary: boundary <= score < high; low: everything else):

    target     = max(1, floor(n * rate))
    q_high     = min(target, n_high)                       uniform draw
    q_boundary = min(target - q_high, n_boundary)          weighted draw,
                 weight exp(2 * (score - boundary) / (high - boundary))
    q_low      = min(target - q_high - q_boundary, n_low)  uniform draw

One aggregate gives the three stratum sizes and the bucket of each stratum's cutoff,
a second scan the exact (key, id) cutoffs of the strata with a partial quota, and
``show`` is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersift.functions.hashing import hash_unit, weighted_key
from papersift.operators.topk import before_or_at, stratified_cutoffs

HIGH, BOUNDARY, LOW = "high", "boundary", "low"
BAD = "bad"
PURPOSE_NEGATIVES = "negatives"
PURPOSE_SHOW = "show"


def quota(n: int, rate: float) -> int:
    """R2: ``max(1, int(n * rate))``."""
    return max(1, int(n * rate))


def stratum(score: Column, high: float, boundary: float) -> Column:
    return (
        F.when(score >= F.lit(high), F.lit(HIGH))
        .when((score >= F.lit(boundary)) & (score < F.lit(high)), F.lit(BOUNDARY))
        .otherwise(F.lit(LOW))
    )


def draw_key(score: Column, u: Column, high: float, boundary: float) -> Column:
    """Uniform key for high and low rows, exponential weighted key for boundary rows."""
    if high > boundary:
        w = F.exp(F.lit(2.0) * (score - F.lit(boundary)) / F.lit(high - boundary))
        b_key = weighted_key(u, w)
    else:
        b_key = u  # boundary stratum is empty
    return F.when((score >= F.lit(boundary)) & (score < F.lit(high)), b_key).otherwise(u)


def stratum_counts(df: DataFrame, score_col: str, high: float, boundary: float) -> dict:
    s = F.col(score_col)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(s.isNull() | F.isnan(s)).alias("bad"),
        F.count_if(s >= F.lit(high)).alias(HIGH),
        F.count_if((s >= F.lit(boundary)) & (s < F.lit(high))).alias(BOUNDARY),
    ).first()
    n = row["n"]
    return {"n": n, "bad": row["bad"], HIGH: row[HIGH], BOUNDARY: row[BOUNDARY], LOW: n - row[HIGH] - row[BOUNDARY]}


def stratum_quotas(counts: dict, rate: float) -> dict:
    if counts["n"] == 0:
        return {HIGH: 0, BOUNDARY: 0, LOW: 0, "target": 0}
    target = quota(counts["n"], rate)
    q_high = min(target, counts[HIGH])
    q_boundary = min(target - q_high, counts[BOUNDARY])
    q_low = min(target - q_high - q_boundary, counts[LOW])
    return {HIGH: q_high, BOUNDARY: q_boundary, LOW: q_low, "target": target}


def adaptive_sample(
    df: DataFrame,
    rate: float,
    high: float = 0.85,
    boundary: float = 0.6,
    seed: int = 42,
    score_col: str = "score",
    id_col: str = "id",
    purpose: str = PURPOSE_SHOW,
) -> DataFrame:
    """Add ``show`` (tinyint 1/0) to every row.

    NaN and null scores are rejected: Spark orders NaN above every number, so
    they would silently land in the high stratum.  Ids must be unique.
    """
    score = F.col(score_col)
    u = hash_unit(F.col(id_col), seed, purpose)
    key = draw_key(score, u, high, boundary)
    strat = stratum(score, high, boundary)
    idc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # exponential keys fall in [0, 1) by their own distribution at weight 1; a missing id has no key
    position = F.coalesce(F.when(strat == F.lit(BOUNDARY), F.lit(1.0) - F.exp(-key)).otherwise(u), F.lit(0.0))

    def quotas_of(sizes: dict[str, int]) -> dict[str, int]:
        if sizes.get(BAD):
            raise ValueError(f"{sizes[BAD]} rows have a null or NaN {score_col}; score them first")
        counts = {s: sizes.get(s, 0) for s in (HIGH, BOUNDARY, LOW)}
        quotas.update(stratum_quotas({"n": sum(counts.values()), **counts}, rate))
        return {s: quotas[s] for s in counts}

    quotas: dict[str, int] = {}
    usable = F.when(score.isNull() | F.isnan(score), F.lit(BAD)).otherwise(strat)
    sizes, cutoffs = stratified_cutoffs(df, usable, key, position, idc, quotas_of)
    show = F.lit(False)
    for name in (HIGH, BOUNDARY, LOW):
        in_stratum = strat == F.lit(name)
        if name in cutoffs:
            show = show | (in_stratum & before_or_at(key, idc, cutoffs[name]))
        elif 0 < sizes.get(name, 0) <= quotas[name]:
            show = show | in_stratum
    return df.withColumn("show", show.cast("tinyint"))


def force_include(df: DataFrame) -> DataFrame:
    """Every row is shown."""
    return df.withColumn("show", F.lit(1).cast("tinyint"))


def uniform_draw(
    df: DataFrame,
    n: int,
    seed: int = 42,
    id_col: str = "id",
    purpose: str = PURPOSE_NEGATIVES,
    clip: bool = False,
) -> DataFrame:
    """Exactly ``n`` rows, uniform, without replacement.

    Asking for more rows than exist raises unless ``clip`` is set, in which
    case every row is returned.
    """
    if n <= 0:
        return df.limit(0)
    u = hash_unit(F.col(id_col), seed, purpose)
    idc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # The first scan also says whether n rows exist at all.
    sizes, cutoffs = stratified_cutoffs(df, F.lit("all"), u, F.coalesce(u, F.lit(0.0)), idc, lambda _: {"all": n})
    got = sizes.get("all", 0)
    if got < n and not clip:
        raise ValueError(f"asked for {n} rows but only {got} are available")
    return df if got <= n else df.where(before_or_at(u, idc, cutoffs["all"]))
