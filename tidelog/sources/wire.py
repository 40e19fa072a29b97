"""Binary change messages to columns.

Control messages have fixed offsets and are read with built-in binary functions. Row
images have variable length: they are read batch by batch with numpy, one step per column
position for all messages of an Arrow batch at once, never message by message.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.lsn import from_hex, pg_timestamp
from tidelog.schema import COLUMNS, MESSAGE_LETTERS, TUPLE

_BODY = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("ident_is_key", T.BooleanType()),
        T.StructField("ident", TUPLE),
        T.StructField("new_row", TUPLE),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("replica_identity", T.StringType()),
        T.StructField("columns", COLUMNS),
        T.StructField("corrupt", T.BooleanType()),
    ]
)

_CELL_ARROW = pa.struct([("kind", pa.string()), ("value", pa.string())])
_COLUMNS_ARROW = pa.list_(
    pa.struct([("is_key", pa.bool_()), ("name", pa.string()), ("type_oid", pa.int64()), ("typmod", pa.int32())])
)
# Shortest length of each message, by letter.
_SHORTEST = {"B": 21, "C": 26, "O": 10, "R": 10, "Y": 7, "I": 6, "U": 6, "D": 6, "T": 6}
_PAD = 16


def _u16(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (buf[at].astype(np.int64) << 8) | buf[at + 1]


def _u32(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (_u16(buf, at) << 16) | _u16(buf, at + 2)


def _strings(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Gather byte ranges of ``buf`` into one string array."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    source = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    bitmap = np.packbits(valid, bitorder="little")
    return pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buf[source]), pa.py_buffer(bitmap)
    )


class _Tuples:
    """Row images of one side, for a subset of the messages of a batch."""

    def __init__(self, buf: np.ndarray, rows: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.buf, self.rows = buf, rows
        limit = len(buf) - _PAD
        ok = at + 2 <= end
        count = np.where(ok, _u16(buf, np.minimum(at, limit)), 0)
        at = at + 2
        # A cell takes at least one byte, so a larger count cannot be true.
        ok &= at + count <= end
        count = np.where(ok, count, 0)
        width = int(count.max()) if len(count) else 0
        kind = np.zeros((len(rows), width), dtype=np.uint8)
        start = np.zeros((len(rows), width), dtype=np.int64)
        length = np.zeros((len(rows), width), dtype=np.int64)
        for i in range(width):
            here = ok & (i < count)
            seen = np.minimum(at, limit)
            k = buf[seen]
            text = here & (k == ord("t"))
            size = np.where(text, _u32(buf, np.minimum(seen + 1, limit)), 0)
            after = at + np.where(here, 1 + np.where(text, 4 + size, 0), 0)
            good = ~here | ((after <= end) & (text | (k == ord("n")) | (k == ord("u"))))
            ok &= good
            kind[:, i] = np.where(here & good, k, 0)
            start[:, i] = seen + 5
            length[:, i] = np.where(good, size, 0)
            at = np.where(good, after, end)
        self.ok, self.after = ok, np.minimum(at, limit)
        self.count = np.where(ok, count, 0)
        self.kind, self.start, self.length = kind, start, length

    def array(self, n: int) -> pa.Array:
        """List column over all ``n`` messages; null where a message has no such image."""
        counts = np.zeros(n, dtype=np.int64)
        counts[self.rows] = self.count
        present = np.zeros(n, dtype=bool)
        present[self.rows] = self.ok
        offsets = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(counts, out=offsets[1:])
        mask = np.arange(self.kind.shape[1]) < self.count[:, None]
        kind, start, length = self.kind[mask], self.start[mask], self.length[mask]
        codes = np.where(kind == ord("n"), 0, np.where(kind == ord("u"), 1, 2)).astype(np.int32)
        kinds = pa.array(["n", "u", "t"]).take(pa.array(codes))
        values = _strings(self.buf, start, length, kind == ord("t"))
        cells = pa.StructArray.from_arrays([kinds, values], fields=list(_CELL_ARROW))
        return pa.ListArray.from_arrays(pa.array(offsets), cells, mask=pa.array(~present))


def _relation(data: bytes) -> tuple:
    """Namespace, name, identity and columns of one Relation message. These are rare."""
    rest = data[5:]
    namespace, rest = rest.split(b"\0", 1)
    name, rest = rest.split(b"\0", 1)
    identity = chr(rest[0])
    (size,) = struct.unpack_from(">H", rest, 1)
    rest = rest[3:]
    columns = []
    for _ in range(size):
        is_key = rest[0] != 0
        column, rest = rest[1:].split(b"\0", 1)
        type_oid, typmod = struct.unpack_from(">Ii", rest)
        rest = rest[8:]
        columns.append({"is_key": is_key, "name": column.decode(), "type_oid": type_oid, "typmod": typmod})
    return namespace.decode(), name.decode(), identity, columns


def _decode_bodies(raw: pa.Array, fail_fast: bool) -> pa.Array:
    if pa.types.is_large_binary(raw.type):
        raw = raw.cast(pa.binary())
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
    data = raw.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    buf = np.concatenate([body, np.zeros(_PAD, dtype=np.uint8)])
    start, end = offsets[:-1], offsets[1:]
    letter = np.where(end > start, buf[start], 0)
    corrupt = np.ones(n, dtype=bool)
    for code, size in _SHORTEST.items():
        corrupt &= ~((letter == ord(code)) & (end - start >= size))

    def has(*codes: str) -> np.ndarray:
        return ~corrupt & np.isin(letter, [ord(c) for c in codes])

    with_oid = has("I", "U", "D", "R")
    oid = np.where(with_oid, _u32(buf, np.where(with_oid, start + 1, 0)), 0)
    marker = np.where(with_oid, buf[np.where(with_oid, start + 5, 0)], 0)
    is_key = marker == ord("K")
    old = has("U", "D") & (is_key | (marker == ord("O")))
    old_rows = np.flatnonzero(old)
    ident = _Tuples(buf, old_rows, start[old_rows] + 6, end[old_rows])
    corrupt[old_rows] |= ~ident.ok

    new_at = np.where(has("I", "U") & (marker == ord("N")), start + 6, -1)
    both = (letter[old_rows] == ord("U")) & ident.ok
    follows = both & (ident.after < end[old_rows]) & (buf[ident.after] == ord("N"))
    new_at[old_rows[follows]] = ident.after[follows] + 1
    # An insert or update without its new image, or a delete without an identity, was cut.
    corrupt |= (has("I", "U") & (new_at < 0)) | (has("D") & ~old)
    new_rows = np.flatnonzero(new_at >= 0)
    new = _Tuples(buf, new_rows, new_at[new_rows], end[new_rows])
    corrupt[new_rows] |= ~new.ok

    names: list = [None] * n
    spaces: list = [None] * n
    identities: list = [None] * n
    columns: list = [None] * n
    for i in np.flatnonzero(has("R")):
        try:
            spaces[i], names[i], identities[i], columns[i] = _relation(raw[i].as_py())
        except (ValueError, IndexError, struct.error):
            corrupt[i] = True

    if fail_fast and corrupt.any():
        bad = int(np.flatnonzero(corrupt)[0])
        head = bytes(body[start[bad] : min(end[bad], start[bad] + 16)]).hex()
        raise ValueError(f"{int(corrupt.sum())} unreadable change messages, the first starts with {head!r}")

    return pa.StructArray.from_arrays(
        [
            pa.array(oid, mask=~(with_oid & ~corrupt)),
            pa.array(is_key, mask=~(old & ~corrupt)),
            ident.array(n),
            new.array(n),
            pa.array(spaces, pa.string()),
            pa.array(names, pa.string()),
            pa.array(identities, pa.string()),
            pa.array(columns, _COLUMNS_ARROW),
            pa.array(corrupt),
        ],
        names=[f.name for f in _BODY.fields],
    )


def _number(raw: Column, at: int, size: int) -> Column:
    return from_hex(F.hex(F.substring(raw, at, size)))


def _signed32(raw: Column, at: int) -> Column:
    value = _number(raw, at, 4)
    return F.when(value >= 2147483648, value - 4294967296).otherwise(value).cast("int")


def _time(raw: Column, at: int) -> Column:
    return pg_timestamp(F.conv(F.hex(F.substring(raw, at, 8)), 16, -10).cast("bigint"))


def _text(raw: Column, at: int, part: int) -> Column:
    rest = F.substr(raw, F.lit(at)).cast("string")
    return F.get(F.split(rest, "\0"), F.lit(part))


def _truncated_oids(raw: Column) -> Column:
    count = _number(raw, 2, 4)
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda i: from_hex(F.hex(F.substr(raw, (i * 4 + 7).cast("int"), F.lit(4)))),
    )).otherwise(F.array().cast("array<bigint>"))


def message_type(raw: Column) -> Column:
    """Name of the message type, null for a letter that is none."""
    letter = F.substring(raw, 1, 1).cast("string")
    names = F.create_map(*[F.lit(x) for pair in MESSAGE_LETTERS.items() for x in pair])
    return F.try_element_at(names, letter)


def control_fields(raw: Column) -> dict[str, Column]:
    """Fields of begin, commit, origin, type and truncate messages; all built-in functions."""
    kind = F.substring(raw, 1, 1).cast("string")
    size = F.octet_length(raw)

    def of(letter: str, value: Column) -> Column:
        return F.when((kind == letter) & (size >= _SHORTEST[letter]), value)

    def either(*choices: Column) -> Column:
        return F.coalesce(*choices)

    options = F.conv(F.hex(F.substring(raw, 6, 1)), 16, 10).cast("int")
    return {
        "xid": of("B", _signed32(raw, 18)),
        "final_lsn": of("B", _number(raw, 2, 8)),
        "commit_ts": either(of("B", _time(raw, 10)), of("C", _time(raw, 19))),
        "relation_oids": of("T", _truncated_oids(raw)),
        "cascade": of("T", options.bitwiseAND(F.lit(1)) != 0),
        "restart_identity": of("T", options.bitwiseAND(F.lit(2)) != 0),
        "commit_lsn": of("C", _number(raw, 3, 8)),
        "end_lsn": of("C", _number(raw, 11, 8)),
        "flags": of("C", F.conv(F.hex(F.substring(raw, 2, 1)), 16, 10).cast("int")),
        "namespace": of("Y", _text(raw, 6, 0)),
        "name": either(of("O", _text(raw, 10, 0)), of("Y", _text(raw, 6, 1))),
        "type_oid": of("Y", _number(raw, 2, 4)),
        "origin_lsn": of("O", _number(raw, 2, 8)),
    }


def decode_control(df: DataFrame) -> DataFrame:
    """Decode control messages only, without leaving the JVM; row images stay in ``raw``."""
    fields = control_fields(F.col("raw"))
    return df.select(*df.columns, message_type(F.col("raw")).alias("msg_type"), *[c.alias(n) for n, c in fields.items()])


def decode_messages(df: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Decode ``raw`` to the canonical change columns, keeping all columns of ``df``.

    ``FAILFAST`` fails the job at the first unreadable message; ``PERMISSIVE`` keeps such a
    message with ``_corrupt`` set and null fields.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    fail_fast = mode == "FAILFAST"
    schema = T.StructType([*df.schema.fields, T.StructField("__body", _BODY)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bodies = _decode_bodies(batch.column(batch.schema.get_field_index("raw")), fail_fast)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, bodies], names=[*batch.schema.names, "__body"]
                )

    parsed = df.mapInArrow(decode, schema)
    fields = control_fields(F.col("raw"))
    body = F.col("__body")
    columns = {
        "msg_type": message_type(F.col("raw")),
        "relation_oid": body["relation_oid"],
        **fields,
        "ident_is_key": body["ident_is_key"],
        "ident": body["ident"],
        "new_row": body["new_row"],
        "namespace": F.coalesce(body["namespace"], fields["namespace"]),
        "name": F.coalesce(body["name"], fields["name"]),
        "replica_identity": body["replica_identity"],
        "columns": body["columns"],
    }
    if not fail_fast:
        columns["_corrupt"] = body["corrupt"]
    kept = [c for c in df.columns if c not in columns]
    # A relation id that the frame's source already knows fills in for control messages.
    if "relation_oid" in df.columns:
        columns["relation_oid"] = F.coalesce(body["relation_oid"], F.col("relation_oid"))
    return parsed.select(*kept, *[c.alias(n) for n, c in columns.items()])
