"""Readers: JSON lines, JSON arrays, parquet datasets, typed tables."""

from .order import order_key
from .rows import (
    BAD_JSON,
    json_elements,
    read_columnar,
    read_json_array,
    read_json_lines,
    read_rows,
    rows_from_table,
    union_rows,
)

__all__ = [
    "BAD_JSON",
    "json_elements",
    "order_key",
    "read_columnar",
    "read_json_array",
    "read_json_lines",
    "read_rows",
    "rows_from_table",
    "union_rows",
]
