"""Cells, tuples and key columns of a row image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import NULL_CELL, TEXT_CELL, UNCHANGED_CELL


def cell(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.cast("string").alias("value"))


def text_cell(value: Column) -> Column:
    """A sent value: text, or the null marker where the value is null."""
    return cell(F.when(value.isNull(), F.lit(NULL_CELL)).otherwise(F.lit(TEXT_CELL)), value)


def is_null(c: Column) -> Column:
    return c["kind"] == NULL_CELL


def is_text(c: Column) -> Column:
    return c["kind"] == TEXT_CELL


def is_unchanged(c: Column) -> Column:
    return c["kind"] == UNCHANGED_CELL


def kind_name(c: Column) -> Column:
    """Kind spelled out; anything else is ``unknown``."""
    return (
        F.when(is_null(c), F.lit("null"))
        .when(is_unchanged(c), F.lit("unchanged"))
        .when(is_text(c), F.lit("text"))
        .otherwise(F.lit("unknown"))
    )


def key_columns(columns: Column) -> Column:
    return F.filter(columns, lambda c: c["is_key"])


def key_names(columns: Column) -> Column:
    return F.transform(key_columns(columns), lambda c: c["name"])


def zip_columns(columns: Column, cells: Column) -> Column:
    """Pair the positional cells of a tuple with the relation's columns."""
    return F.zip_with(
        columns,
        cells,
        lambda c, v: F.struct(
            c["name"].alias("name"),
            c["is_key"].alias("is_key"),
            c["type_oid"].alias("type_oid"),
            v["kind"].alias("kind"),
            v["value"].alias("value"),
        ),
    )


def match_cells(ident: Column, ident_is_key: Column, new_row: Column, columns: Column) -> Column:
    """The ``(name, kind, value)`` cells that locate the old row.

    With an identity tuple: its text cells, and its null cells too under full identity.
    Without one the key did not change, so the key cells of the new row locate the row.
    """
    from_ident = F.filter(
        zip_columns(columns, ident),
        lambda z: (z["kind"] == TEXT_CELL) | ((z["kind"] == NULL_CELL) & ~ident_is_key),
    )
    from_new = F.filter(
        zip_columns(columns, new_row), lambda z: z["is_key"] & z["kind"].isin(TEXT_CELL, NULL_CELL)
    )
    return F.when(ident.isNotNull(), from_ident).otherwise(from_new)


def key_values(cells: Column, key_ordinals: Sequence[int]) -> Column:
    """Key of a row as an array of the key cells' text."""
    return F.array(*[F.get(cells, F.lit(i))["value"] for i in key_ordinals])
