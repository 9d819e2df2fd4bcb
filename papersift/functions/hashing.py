"""Content-hash random numbers.

A draw must not depend on partitioning, task retries or executor loss, so no
``rand(seed)`` and no ``DataFrame.sample``.  The uniform number of a row is a
pure function of its key, the seed and the purpose of the draw:

    h = first 13 hex digits of md5(key '#' seed '#' purpose)   (52 bits)
    u = (h + 0.5) / 2**52                                      (0 < u < 1)

DuckDB computes the same number with
``(('0x' || substr(md5(key || '#' || seed || '#' || purpose), 1, 13))::BIGINT + 0.5) / 4503599627370496``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = float(2**52)


def hash_unit(key: Column | str, seed: int, purpose: str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat_ws("#", key.cast("string"), F.lit(str(seed)), F.lit(purpose))
    h = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return (h.cast("double") + F.lit(0.5)) / F.lit(TWO_POW_52)


def weighted_key(u: Column, weight: Column) -> Column:
    """Exponential key ``-ln(u) / w``: the k smallest keys are a weighted draw of k
    rows without replacement (Efraimidis & Spirakis, 2006)."""
    return -F.log(u) / weight


def sql_hash_unit(key_sql: str, seed: int, purpose: str) -> str:
    """The same number as DuckDB SQL text (used by the oracles)."""
    return (
        f"((('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || '#{seed}#{purpose}'), 1, 13))::BIGINT"
        f" + 0.5) / 4503599627370496.0)"
    )
