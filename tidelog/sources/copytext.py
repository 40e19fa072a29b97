"""COPY text snapshots: tab separated, ``\\N`` for null, backslash escapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.text import copy_escape, copy_unescape
from tidelog.functions.types import strictly_typed, typed


def parse_copy_lines(
    lines: DataFrame, columns: Sequence, line: str = "value", as_text: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    """COPY lines to rows. An escaped tab is written with a letter, so a real tab always
    separates fields.

    A line with too few or too many fields, or with a text that its column's type cannot
    hold, fails the job. Under ``PERMISSIVE`` every row has the line in ``_corrupt_line`` if
    its fields are miscounted (then all columns are null), and in ``_cast_errors`` the number
    of values that were lost.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    names = [c["name"] for c in columns]
    fields = F.split(F.col(line), "\t", -1)
    whole = F.size(fields) == len(columns)
    if mode == "FAILFAST":
        told = F.raise_error(F.concat(F.lit(f"COPY line without {len(columns)} fields: "), F.col(line)))
        fields = F.when(whole, fields).otherwise(told)
    else:
        fields = F.when(whole, fields)
    text = lines.where(F.col(line) != "\\.").select(
        *[copy_unescape(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)],
        *([F.when(~whole, F.col(line)).alias("_corrupt_line")] if mode == "PERMISSIVE" else []),
    )
    if as_text:
        return text
    if mode == "FAILFAST":
        return strictly_typed(text, columns)
    out = typed(text, columns, keep=["_corrupt_line"], errors="_cast_errors")
    return out.select(*names, "_corrupt_line", "_cast_errors")


def read_copy_text(
    spark: SparkSession, path: str, columns: Sequence, as_text: bool = False, mode: str = "FAILFAST"
) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return parse_copy_lines(lines, columns, as_text=as_text, mode=mode)


def copy_line(*values: Column) -> Column:
    """Values (text form) as one COPY line."""
    return F.concat_ws("\t", *[copy_escape(v.cast("string")) for v in values])
