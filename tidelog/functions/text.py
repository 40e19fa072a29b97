"""Quoting for SQL text and escaping for the COPY text format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the COPY text format and quoted literals write with a backslash.
LITERAL_ESCAPES = {"\t": "\\t", "\r": "\\r", "\n": "\\n"}
COPY_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v"}
COPY_NULL = "\\N"
_HOLD = "\x00"  # never occurs in database text


def _replace(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def quote_literal(text: Column) -> Column:
    """SQL string literal: single quotes doubled, ``E'…'`` wherever a backslash is written."""
    body = _replace(text, "\\", "\\\\")
    for char, escaped in LITERAL_ESCAPES.items():
        body = _replace(body, char, escaped)
    body = _replace(body, "'", "''")
    return F.when(F.contains(body, F.lit("\\")), F.concat(F.lit("E'"), body, F.lit("'"))).otherwise(
        F.concat(F.lit("'"), body, F.lit("'"))
    )


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), _replace(name, '"', '""'), F.lit('"'))


def quote_name(namespace: Column, name: Column) -> Column:
    return F.concat_ws(".", quote_ident(namespace), quote_ident(name))


def copy_escape(text: Column) -> Column:
    body = _replace(text, "\\", "\\\\")
    for char, escaped in COPY_ESCAPES.items():
        body = _replace(body, char, escaped)
    return F.coalesce(body, F.lit(COPY_NULL))


def copy_unescape(field: Column) -> Column:
    """One COPY field to text. Doubled backslashes are held aside, so that a backslash
    in front of a letter is always an escape; a backslash before anything else goes."""
    body = _replace(field, "\\\\", _HOLD)
    for char, escaped in COPY_ESCAPES.items():
        body = _replace(body, escaped, char)
    body = F.regexp_replace(body, r"\\(.)", "$1")
    body = _replace(body, _HOLD, "\\")
    return F.when(field != F.lit(COPY_NULL), body)
