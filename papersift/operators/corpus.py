"""Corpus filters and splits: P1 P2 P4 P5 P6 P15, J1 J2 J3."""

from __future__ import annotations

import datetime as _dt
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papersift.functions.text import all_of
from papersift.operators.joins import anti, semi


def category_any(df: DataFrame, categories: list[str] | tuple[str, ...], col: str = "categories") -> DataFrame:
    """Keep rows whose category list holds any of ``categories``; a null list drops the row."""
    wanted = F.array(*[F.lit(c) for c in categories])
    return df.where(F.arrays_overlap(F.col(col), wanted))


def with_all_embeddings(df: DataFrame, embedding_columns: list[str] | tuple[str, ...]) -> DataFrame:
    """Every embedding column is present (``IsNotNull`` reaches the Parquet scan)."""
    return df.where(all_of([F.col(c).isNotNull() for c in embedding_columns]))


def split_rated(papers: DataFrame, preferences: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rated papers with their preference, unrated papers).

    A null id is in neither part, matching list membership semantics.
    """
    papers = papers.where(F.col(id_col).isNotNull())
    prefs = preferences.where(F.col(id_col).isNotNull())
    rated = papers.join(prefs, id_col, "inner")
    unrated = papers.join(prefs.select(id_col), id_col, "left_anti")
    return rated, unrated


def effective_start_year(background_start_year: int, preference_start_year: int, override: int | None = None) -> int:
    """``max(2017, min(override or background, preference, background))``."""
    base = background_start_year if override is None else override
    return max(2017, min(base, preference_start_year, background_start_year))


def needs_year_cutoff(background_start_year: int, preference_start_year: int) -> bool:
    """P5 applies only when the effective start year is before the background start year."""
    return effective_start_year(background_start_year, preference_start_year) < background_start_year


def year_cutoff(df: DataFrame, min_year: int, updated_col: str = "updated") -> DataFrame:
    """P5: keep rows updated in ``min_year`` or later; adds the ``year`` column.

    The text comparison is a copy Parquet can use (the cast form is not pushed).
    Malformed years raise under ANSI casts, as the integer parse would.
    """
    year = F.substring(F.col(updated_col), 1, 4).cast("int")
    return (
        df.where(F.col(updated_col) >= F.lit(f"{min_year:04d}"))
        .withColumn("year", year)
        .where(F.col("year") >= F.lit(min_year))
    )


def remove_digested(df: DataFrame, digested_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop papers already in the archive (anti join; no ``NOT IN`` null trap)."""
    return anti(df, digested_ids.where(F.col(id_col).isNotNull()), id_col)


def date_window(
    df: DataFrame,
    start_date: str = "",
    end_date: str = "",
    last_n_days: int = 7,
    today: _dt.date | str | None = None,
    updated_col: str = "updated",
) -> DataFrame:
    """Inclusive text window when both bounds are set, else ``updated >= today - N days``.

    ``today`` is a parameter (never read inside a query) so results are reproducible.
    """
    upd = F.col(updated_col)
    if start_date and end_date:
        return df.where((upd >= F.lit(start_date)) & (upd <= F.lit(end_date)))
    if start_date or end_date:
        warnings.warn("only one date bound is set; falling back to the last-N-days window")
    if today is None:
        today = _dt.date.today()
    if isinstance(today, str):
        today = _dt.date.fromisoformat(today)
    cutoff = (today - _dt.timedelta(days=last_n_days)).strftime("%Y-%m-%d")
    return df.where(upd >= F.lit(cutoff))


def last_n_days_cutoff(today: Column, n: int) -> Column:
    """F10 as an expression: ``today - n days`` as ``yyyy-MM-dd`` text."""
    return F.date_format(F.date_sub(today, n), "yyyy-MM-dd")


def id_list_filter(df: DataFrame, ids: list[str] | DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the listed ids (literal list for short lists, semi join for tables)."""
    if isinstance(ids, DataFrame):
        return semi(df, ids, id_col)
    return df.where(F.col(id_col).isin(list(ids)))


def parse_ids(arg: str) -> list[str]:
    """Split a comma list, trim, drop blanks."""
    return [x.strip() for x in arg.split(",") if x.strip()]


def start_year_of_ids(ids: list[str]) -> int:
    """2000 + the smallest two-digit prefix."""
    return 2000 + min(int(i[:2]) for i in ids)
