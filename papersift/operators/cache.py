"""Cached digests: P11 P12 D2 T1 J4 D6 U4 J5."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.operators.dedup import latest_per_key
from papersift.operators.joins import anti, semi


def model_pattern(acceptable_models: list[str] | tuple[str, ...]) -> str:
    """The configured names are regex alternatives anchored at the start.

    They look like wildcards but act as regexes: ``grok*`` is "gro" then any
    number of k's, matched as a prefix.
    """
    return "^(" + "|".join(acceptable_models) + ")"


def accepted(cache: DataFrame, wanted_ids: DataFrame, language: str,
             acceptable_models: list[str] | tuple[str, ...], id_col: str = "id") -> DataFrame:
    """Wanted id AND same language AND model matches one accepted pattern."""
    rows = cache.where((F.col("lang") == F.lit(language)) & F.col("model").rlike(model_pattern(acceptable_models)))
    # No distinct: a semi join ignores duplicate keys, so no extra shuffle is needed.
    return semi(rows, wanted_ids.where(F.col(id_col).isNotNull()), id_col)


def with_default(df: DataFrame, column: str, value) -> DataFrame:
    """Add a constant column only when it is absent."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def latest_cached(cache: DataFrame, wanted_ids: DataFrame, language: str,
                  acceptable_models: list[str] | tuple[str, ...], id_col: str = "id",
                  tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """S4 (after the scan) + P11 + D2 + P12: newest accepted digest per wanted id."""
    ok = accepted(cache, wanted_ids, language, acceptable_models, id_col)
    newest = latest_per_key(ok, id_col, ["summary_time", *tie_cols])
    return with_default(newest, "preference", "unknown")


def misses(wanted: DataFrame, cached: DataFrame, id_col: str = "id") -> DataFrame:
    """Wanted rows with no accepted cached digest."""
    return anti(wanted, cached.select(id_col), id_col)


def combine(fresh: DataFrame, cached: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per id; a cached row wins over a fresh one."""
    return anti(fresh, cached.select(id_col), id_col).unionByName(cached, allowMissingColumns=True)


def merge_metadata(summaries: DataFrame, papers: DataFrame, id_col: str = "id") -> DataFrame:
    """Summaries left-joined with paper metadata.

    On a name clash the paper's value wins whenever the paper exists, even if
    that value is null; summaries with no paper keep their own values.
    """
    p = papers.withColumn("__has_paper", F.lit(True))
    s_cols = [c for c in summaries.columns if c != id_col]
    p_cols = [c for c in papers.columns if c != id_col]
    joined = summaries.alias("s").join(p.alias("p"), id_col, "left")
    has = F.col("p.__has_paper").isNotNull()
    out = [F.col(id_col)]
    for c in s_cols:
        if c in p_cols:
            out.append(F.when(has, F.col(f"p.`{c}`")).otherwise(F.col(f"s.`{c}`")).alias(c))
        else:
            out.append(F.col(f"s.`{c}`"))
    out += [F.col(f"p.`{c}`") for c in p_cols if c not in s_cols]
    return joined.select(*out)
