"""Ratings from a bibliography export: F3 F4 D4 T3.

Fixed patterns (an arXiv id is four digits, a dot and five digits):
    Extra              arXiv:(\\d{4}\\.\\d{5})
    Url                arxiv\\.org/abs/(\\d{4}\\.\\d{5})
    Publication Title  arXiv:(\\d{4}\\.\\d{5})
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersift.functions.text import first_of_captures

ARXIV_RULES = [
    ("Extra", r"arXiv:(\d{4}\.\d{5})"),
    ("Url", r"arxiv\.org/abs/(\d{4}\.\d{5})"),
    ("Publication Title", r"arXiv:(\d{4}\.\d{5})"),
]


def extract_ids(df: DataFrame, rules: list[tuple[str, str]] = ARXIV_RULES) -> DataFrame:
    """First rule that matches wins per row; distinct ids."""
    present = [(c, p) for c, p in rules if c in df.columns]
    ident = first_of_captures([(F.col(f"`{c}`"), p) for c, p in present]) if present else F.lit(None)
    return df.select(ident.cast("string").alias("id")).where(F.col("id").isNotNull()).distinct()


def ratings_from_ids(ids: DataFrame, preference: str = "like") -> DataFrame:
    """K3 rows: one constant rating per id, ascending id order."""
    return ids.select("id", F.lit(preference).alias("preference")).orderBy("id")
