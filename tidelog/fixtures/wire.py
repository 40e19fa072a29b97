"""Encoders that turn rows into binary change messages and segments, to feed the readers.

Test input only: segments are not an output format of this package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lsn import EPOCH_2000_MICROS


def _hex(value: Column, size: int) -> Column:
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.substring(digits, -2 * size, 2 * size)


def _byte(char: str) -> Column:
    return F.lit(char.encode().hex().upper())


def _cstring(text: Column) -> Column:
    return F.concat(F.hex(F.encode(text, "UTF-8")), F.lit("00"))


def _time(micros: Column) -> Column:
    return _hex(micros - F.lit(EPOCH_2000_MICROS), 8)


def cells_hex(cells: Column) -> Column:
    def one(c: Column) -> Column:
        value = F.hex(F.encode(c["value"], "UTF-8"))
        text = F.concat(_byte("t"), _hex(F.length(value) / 2, 4), value)
        return F.when(c["kind"] == "t", text).when(c["kind"] == "u", _byte("u")).otherwise(_byte("n"))

    return F.concat(_hex(F.size(cells), 2), F.array_join(F.transform(cells, one), ""))


def begin(final_lsn: Column, commit_micros: Column, xid: Column) -> Column:
    return F.unhex(F.concat(_byte("B"), _hex(final_lsn, 8), _time(commit_micros), _hex(xid, 4)))


def commit(lsn: Column, end_lsn: Column, commit_micros: Column, flags: Column | None = None) -> Column:
    flag = _hex(flags, 1) if flags is not None else F.lit("00")
    return F.unhex(F.concat(_byte("C"), flag, _hex(lsn, 8), _hex(end_lsn, 8), _time(commit_micros)))


def origin(lsn: Column, name: Column) -> Column:
    return F.unhex(F.concat(_byte("O"), _hex(lsn, 8), _cstring(name)))


def type_(oid: Column, namespace: Column, name: Column) -> Column:
    return F.unhex(F.concat(_byte("Y"), _hex(oid, 4), _cstring(namespace), _cstring(name)))


def relation(oid: Column, namespace: Column, name: Column, identity: Column, columns: Column) -> Column:
    def one(c: Column) -> Column:
        return F.concat(
            F.when(c["is_key"], "01").otherwise("00"), _cstring(c["name"]), _hex(c["type_oid"], 4), _hex(c["typmod"], 4)
        )

    return F.unhex(
        F.concat(
            _byte("R"),
            _hex(oid, 4),
            _cstring(namespace),
            _cstring(name),
            F.hex(F.encode(identity, "UTF-8")),
            _hex(F.size(columns), 2),
            F.array_join(F.transform(columns, one), ""),
        )
    )


def insert(oid: Column, new_row: Column) -> Column:
    return F.unhex(F.concat(_byte("I"), _hex(oid, 4), _byte("N"), cells_hex(new_row)))


def _ident(ident: Column, is_key: Column) -> Column:
    old = F.concat(F.when(is_key, _byte("K")).otherwise(_byte("O")), cells_hex(ident))
    return F.when(ident.isNotNull(), old).otherwise(F.lit(""))


def update(oid: Column, ident: Column, is_key: Column, new_row: Column) -> Column:
    return F.unhex(
        F.concat(_byte("U"), _hex(oid, 4), _ident(ident, is_key), _byte("N"), cells_hex(new_row))
    )


def delete(oid: Column, ident: Column, is_key: Column) -> Column:
    return F.unhex(F.concat(_byte("D"), _hex(oid, 4), _ident(ident, is_key)))


def truncate(oids: Column, cascade: Column, restart: Column) -> Column:
    options = F.when(cascade, 1).otherwise(0) + F.when(restart, 2).otherwise(0)
    ids = F.array_join(F.transform(oids, lambda o: _hex(o, 4)), "")
    return F.unhex(F.concat(_byte("T"), _hex(F.size(oids), 4), _hex(options, 1), ids))


def segment_content(messages: DataFrame, by: Sequence[str], order: str = "pos") -> DataFrame:
    """Messages (``raw``, ``final_lsn``, ``micros``) as whole segments. A group is one
    segment and so is bounded by the messages per segment."""
    frame = F.concat(_hex(F.octet_length("raw") + 8, 8), F.hex("raw"))
    grouped = messages.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), frame.alias("f")))).alias("frames"),
        F.min("final_lsn").alias("lo"),
        F.max("final_lsn").alias("hi"),
        F.min("micros").alias("t0"),
        F.max("micros").alias("t1"),
    )
    seconds = [F.floor(F.col(c) / 1000000) for c in ("t0", "t1")]
    header = F.concat(
        _hex(F.lit(0), 4),
        _hex(F.col("lo"), 8),
        _hex(F.col("hi"), 8),
        _hex(seconds[0], 8),
        _hex(seconds[1], 8),
        _hex(F.size("frames"), 4),
    )
    body = F.array_join(F.transform("frames", lambda f: f["f"]), "")
    return grouped.select(*by, F.unhex(F.concat(header, body)).alias("content"))
