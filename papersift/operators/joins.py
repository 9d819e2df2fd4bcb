"""Join helpers.

No side is marked for broadcast: the engine chooses the join from measured sizes (its own byte
threshold at planning time, or the shuffled bytes at run time), so a side may grow without bound and
nothing runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def semi(left: DataFrame, right_keys: DataFrame, on: str | list[str]) -> DataFrame:
    keys = right_keys.select(*([on] if isinstance(on, str) else on))
    return left.join(keys, on, "left_semi")


def anti(left: DataFrame, right_keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right_keys``.

    A ``left_anti`` join keeps null keys of ``left`` (unlike ``NOT IN``, which
    returns nothing when the list has a null); callers drop null ids at the scan.
    """
    keys = right_keys.select(*([on] if isinstance(on, str) else on))
    return left.join(keys, on, "left_anti")
