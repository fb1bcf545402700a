"""Catalyst expressions over one column. No Python code runs per row."""

from .cleaning import (
    normalize_boolean,
    normalize_email,
    normalize_number,
    strip_accents,
    to_number,
)
from .dates import date_format_label, is_ambiguous_date, parse_date, parse_timestamp
from .names import name_hint, name_hint_column
from .text import (
    collapse_spaces,
    has_edge_spaces,
    has_special_chars,
    has_sql_unsafe_chars,
    in_range,
    is_date,
    is_email,
    is_integer,
    is_number,
    is_phone,
    is_url,
    special_char_count,
    trim_space,
    truncate,
    value_key,
    value_type,
)

__all__ = [
    "collapse_spaces", "date_format_label", "has_edge_spaces", "has_special_chars",
    "has_sql_unsafe_chars", "in_range", "is_ambiguous_date", "is_date", "is_email",
    "is_integer", "is_number", "is_phone", "is_url", "name_hint", "name_hint_column",
    "normalize_boolean", "normalize_email", "normalize_number", "parse_date",
    "parse_timestamp", "special_char_count", "strip_accents", "to_number", "trim_space",
    "truncate", "value_key", "value_type",
]
