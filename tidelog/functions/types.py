"""Text to typed columns by type id and type modifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public type ids of the source database.
BOOL, BYTEA, INT8, INT2, INT4, TEXT, OID, XID = 16, 17, 20, 21, 23, 25, 26, 28
JSON, FLOAT4, FLOAT8, BPCHAR, VARCHAR, DATE = 114, 700, 701, 1042, 1043, 1082
TIMESTAMP, TIMESTAMPTZ, NUMERIC, UUID, JSONB = 1114, 1184, 1700, 2950, 3802
BOOL_ARRAY, INT2_ARRAY, INT4_ARRAY, TEXT_ARRAY, INT8_ARRAY = 1000, 1005, 1007, 1009, 1016
FLOAT4_ARRAY, FLOAT8_ARRAY = 1021, 1022

_PLAIN = {
    BOOL: "boolean",
    INT2: "smallint",
    INT4: "int",
    INT8: "bigint",
    OID: "bigint",
    XID: "bigint",
    FLOAT4: "float",
    FLOAT8: "double",
}
_DATED = {DATE: "date", TIMESTAMP: "timestamp_ntz", TIMESTAMPTZ: "timestamp"}
_ARRAYS = {
    BOOL_ARRAY: "boolean",
    INT2_ARRAY: "smallint",
    INT4_ARRAY: "int",
    INT8_ARRAY: "bigint",
    FLOAT4_ARRAY: "float",
    FLOAT8_ARRAY: "double",
}


def spark_type(type_oid: int, typmod: int = -1) -> str:
    if type_oid in _PLAIN:
        return _PLAIN[type_oid]
    if type_oid in _DATED:
        return _DATED[type_oid]
    if type_oid in _ARRAYS:
        return f"array<{_ARRAYS[type_oid]}>"
    if type_oid == BYTEA:
        return "binary"
    if type_oid == NUMERIC and typmod >= 4:
        precision, scale = ((typmod - 4) >> 16) & 0xFFFF, (typmod - 4) & 0xFFFF
        if 0 < precision <= 38 and scale <= precision:
            return f"decimal({precision},{scale})"
    return "string"


def typed_value(text: Column, type_oid: int, typmod: int = -1) -> Column:
    """``text`` as its Spark type; null where the text has no value of that type."""
    target = spark_type(type_oid, typmod)
    if target == "string":
        return text
    if type_oid == BYTEA:
        return F.when(text.startswith("\\x"), F.unhex(F.substr(text, F.lit(3))))
    if type_oid in _DATED:
        # A BC date would parse as an AD one.
        return F.when(~text.endswith(" BC"), text.try_cast(target))
    if type_oid in _ARRAYS:
        inner = F.regexp_extract(text, r"^\{([^{}\"]*)\}$", 1)
        items = F.transform(
            F.split(inner, ","), lambda v: F.when(F.upper(v) != "NULL", v.try_cast(_ARRAYS[type_oid]))
        )
        empty = F.array().cast(target)
        return F.when(text == "{}", empty).when(inner != "", items)
    return text.try_cast(target)


def canonical_text(text: Column, type_oid: int, typmod: int = -1) -> Column:
    """One text per value, so that equal values compare equal however they were written
    (``1.50`` and ``1.5``, ``t`` and ``true``). Text without a typed value stays as it is."""
    target = spark_type(type_oid, typmod)
    if target in ("string", "binary") or target.startswith("array"):
        return text
    return F.coalesce(typed_value(text, type_oid, typmod).cast("string"), text)


def as_text(df: DataFrame, columns: Sequence) -> DataFrame:
    """Rows in the text form the log carries. Columns that are text already stay as they are."""
    kinds = dict(df.dtypes)

    def one(name: str, type_oid: int) -> Column:
        kind, col = kinds[name], F.col(name)
        if kind == "string":
            return col
        if kind == "boolean":
            return F.when(col, "t").when(~col, "f")
        if kind == "binary":
            return F.concat(F.lit("\\x"), F.lower(F.hex(col)))
        if kind == "timestamp" and type_oid == TIMESTAMPTZ:
            return F.concat(F.to_utc_timestamp(col, F.current_timezone()).cast("string"), F.lit("+00"))
        if kind.startswith("array"):
            item = F.transform(col, lambda v: F.coalesce(v.cast("string"), F.lit("NULL")))
            return F.concat(F.lit("{"), F.array_join(item, ","), F.lit("}"))
        return col.cast("string")

    return df.select(*[one(c["name"], c["type_oid"]).alias(c["name"]) for c in columns])


def strictly_typed(df: DataFrame, columns: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """``columns`` as typed columns; a text without a value of its type fails the job."""

    def one(c) -> Column:
        text, value = F.col(c["name"]), typed_value(F.col(c["name"]), c["type_oid"], c["typmod"])
        if spark_type(c["type_oid"], c["typmod"]) == "string":
            return text.alias(c["name"])
        told = F.raise_error(F.concat(F.lit(f"no {spark_type(c['type_oid'], c['typmod'])} in column {c['name']}: "), text))
        return F.when(text.isNull() | value.isNotNull(), value).otherwise(told).alias(c["name"])

    return df.select(*keep, *[one(c) for c in columns])


def typed_or_text(df: DataFrame, columns: Sequence, keep: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """``columns`` as typed columns, but a column stays text if it holds values that have no
    Spark value (an infinite date, a NaN decimal, a date BC). Also how many, per such column.

    Counts in one aggregate over ``df``, so hand in something cheap to read."""
    doubtful = [c for c in columns if spark_type(c["type_oid"], c["typmod"]) != "string"]
    if not doubtful:
        return df.select(*keep, *[c["name"] for c in columns]), {}
    lost = df.agg(*[
        F.count_if(F.col(c["name"]).isNotNull() & typed_value(F.col(c["name"]), c["type_oid"], c["typmod"]).isNull()).alias(c["name"])
        for c in doubtful
    ]).first().asDict()
    lost = {name: n for name, n in lost.items() if n}
    out = [
        F.col(c["name"]) if c["name"] in lost else typed_value(F.col(c["name"]), c["type_oid"], c["typmod"]).alias(c["name"])
        for c in columns
    ]
    return df.select(*keep, *out), lost


def typed(df: DataFrame, columns: Sequence, keep: Sequence[str] = (), errors: str | None = "cast_errors") -> DataFrame:
    """Select ``columns`` (name, type_oid, typmod) as typed columns.

    ``errors`` names a count of the values a row lost because their text has no value of
    the target type; ``None`` leaves it out.
    """
    out = [typed_value(F.col(c["name"]), c["type_oid"], c["typmod"]).alias(c["name"]) for c in columns]
    if errors:
        lost = [
            (F.col(c["name"]).isNotNull() & typed_value(F.col(c["name"]), c["type_oid"], c["typmod"]).isNull()).cast(
                "int"
            )
            for c in columns
            if spark_type(c["type_oid"], c["typmod"]) != "string"
        ]
        total = lost[0] if lost else F.lit(0)
        for one in lost[1:]:
            total = total + one
        out.append(total.alias(errors))
    return df.select(*keep, *out)
