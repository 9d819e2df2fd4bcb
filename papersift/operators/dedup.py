"""One row per key: D1 D2 D3 D4 D7.

All of them are aggregates (``max_by`` over an ordering struct), not windows:
the partial aggregate runs before the shuffle, so a hot key that holds a third
of the rows is already down to one row per map task when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed preference ranking used to settle duplicate ratings inside one file.
PREFERENCE_RANK = ["dislike", "neutral", "like"]


def latest_per_key(df: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    """Keep, per key, the row with the largest ``order`` tuple.

    ``order`` should end with columns that make it unique per key; rows with
    equal order tuples are interchangeable.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    if not others:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), ordering).alias("__row"))
    return picked.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def dedupe_ratings(df: DataFrame, source_col: str = "source_file", id_col: str = "id") -> DataFrame:
    """One rating per id; the later source file wins, then like > neutral > dislike."""
    rank = F.array_position(F.array(*[F.lit(x) for x in PREFERENCE_RANK]), F.col("preference"))
    out = latest_per_key(df.where(F.col(id_col).isNotNull()), id_col, [F.col(source_col), rank])
    return out


def key_prefixes(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct four-digit prefixes ``^(\\d{4})\\.`` of the ids (empty ones dropped)."""
    # the filter is on the id: one on the prefix would also be a static filter of a scan that is joined with it
    return df.where(F.col(id_col).rlike(r"^\d{4}\.")).select(F.substring(id_col, 1, 4).alias("month")).distinct()
