"""Column-expression helpers (JVM-side built-ins only, no Python UDFs)."""

from papersift.functions.hashing import hash_unit, weighted_key
from papersift.functions.text import (
    first_capture,
    first_of_captures,
    has_text,
    parse_id_list,
    strip_code_fence,
    clean_equation,
)

__all__ = [
    "hash_unit",
    "weighted_key",
    "first_capture",
    "first_of_captures",
    "has_text",
    "parse_id_list",
    "strip_code_fence",
    "clean_equation",
]
