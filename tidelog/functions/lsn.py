"""Log positions, segment names, shard paths and log timestamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID_LSN = 0
# Fixed value: microseconds from 1970-01-01 to 2000-01-01, the epoch of log timestamps.
EPOCH_2000_MICROS = 946684800000000


def from_hex(text: Column) -> Column:
    """Hexadecimal text to BIGINT; fails where the value does not fit 63 bits."""
    unsigned = F.conv(text, 16, 10).cast("decimal(20,0)")
    return F.when(
        unsigned >= F.lit("9223372036854775808").cast("decimal(20,0)"),
        F.raise_error(F.concat(F.lit("log position above 63 bits: "), text)).cast("bigint"),
    ).otherwise(unsigned.cast("bigint"))


def lsn_parse(text: Column) -> Column:
    """``X/Y`` to BIGINT."""
    high = from_hex(F.substring_index(text, "/", 1))
    low = from_hex(F.substring_index(text, "/", -1))
    return F.shiftleft(high, 32).bitwiseOR(low)


def lsn_format(lsn: Column) -> Column:
    """BIGINT to ``X/Y``."""
    return F.concat_ws("/", F.hex(F.shiftrightunsigned(lsn, 32)), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def lsn_hex(lsn: Column) -> Column:
    return F.lower(F.lpad(F.hex(lsn), 16, "0"))


def lsn_valid(lsn: Column) -> Column:
    return lsn != F.lit(INVALID_LSN)


def segment_name(min_lsn: Column, postfix: Column) -> Column:
    return F.when(postfix == 0, lsn_hex(min_lsn)).otherwise(
        F.concat_ws(".", lsn_hex(min_lsn), postfix.cast("string"))
    )


def segment_lsn(name: Column) -> Column:
    return from_hex(F.substring_index(name, ".", 1))


def segment_postfix_of(name: Column) -> Column:
    """Decimal postfix of a segment name, 0 where there is none."""
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1).cast("int")).otherwise(F.lit(0))


def shard_path(oid: Column) -> Column:
    """Low three bytes of the table id, lowest first, then the id itself."""
    digits = F.lower(F.lpad(F.hex(oid), 8, "0"))
    return F.concat_ws(
        "/", F.substring(digits, 7, 2), F.substring(digits, 5, 2), F.substring(digits, 3, 2), oid.cast("string")
    )


def pg_timestamp(micros: Column) -> Column:
    return F.timestamp_micros(micros + F.lit(EPOCH_2000_MICROS))


def as_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP or TIMESTAMP_NTZ column (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
