"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has_text(col: Column | str) -> Column:
    """True when the string holds a non-whitespace character.

    ``(?U)`` makes ``\\S`` Unicode-aware, so a full-width space counts as blank.
    Null stays null (callers treat null as blank).
    """
    return _c(col).rlike(r"(?U)\S")


def first_capture(col: Column | str, pattern: str, group: int = 1) -> Column:
    """First match's capture group, or null when there is none."""
    return F.nullif(F.regexp_extract(_c(col), pattern, group), F.lit(""))


def first_of_captures(pairs: list[tuple[Column | str, str]]) -> Column:
    """Priority choice (F4): the first column whose pattern matches wins.

    A null or blank column counts as missing.
    """
    return F.coalesce(*[first_capture(c, p) for c, p in pairs])


def parse_id_list(col: Column | str) -> Column:
    """Comma list to array of trimmed, non-blank ids."""
    parts = F.transform(F.split(_c(col), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def strip_code_fence(col: Column | str) -> Column:
    """Remove a Markdown code fence around JSON, only when both ends are there."""
    c = _c(col)
    fenced = c.rlike(r"^\s*```(json)?[\s\S]*```\s*$")
    inner = F.regexp_replace(F.regexp_replace(c, r"^\s*```(json)?\s*", ""), r"\s*```\s*$", "")
    return F.when(fenced, inner).otherwise(c)


# Fixed patterns of the equation cleaner (F15), applied in this order.
EQUATION_COMMAND_PATTERN = r"\\[a-zA-Z]+\[.*?]\{.*?\}\{.*?\}"
EQUATION_DOUBLE_DOLLAR = r"\$\$"
EQUATION_DOLLAR = r"\$"


def clean_equation(col: Column | str) -> Column:
    c = _c(col)
    for pattern in (EQUATION_COMMAND_PATTERN, EQUATION_DOUBLE_DOLLAR, EQUATION_DOLLAR):
        c = F.regexp_replace(c, pattern, "")
    return c


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)
