"""Canonical schemas: the contracts between the modules."""

from __future__ import annotations

from pyspark.sql import types as T

CELL = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
TUPLE = T.ArrayType(CELL)
COLUMN = T.StructType(
    [
        T.StructField("is_key", T.BooleanType()),
        T.StructField("name", T.StringType()),
        T.StructField("type_oid", T.LongType()),
        T.StructField("typmod", T.IntegerType()),
    ]
)
COLUMNS = T.ArrayType(COLUMN)

# Message types and their wire letters.
MESSAGE_LETTERS = {
    "B": "begin",
    "C": "commit",
    "O": "origin",
    "R": "relation",
    "Y": "type",
    "I": "insert",
    "U": "update",
    "D": "delete",
    "T": "truncate",
}
DML_TYPES = ("insert", "update", "delete", "truncate")
ROW_TYPES = ("insert", "update", "delete")

# Cell kinds.
NULL_CELL = "n"
UNCHANGED_CELL = "u"
TEXT_CELL = "t"

CHANGES = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("relation_oid", T.LongType()),
        T.StructField("xid", T.IntegerType()),
        T.StructField("final_lsn", T.LongType()),
        T.StructField("commit_ts", T.TimestampType()),
        T.StructField("ident_is_key", T.BooleanType()),
        T.StructField("ident", TUPLE),
        T.StructField("new_row", TUPLE),
        T.StructField("relation_oids", T.ArrayType(T.LongType())),
        T.StructField("cascade", T.BooleanType()),
        T.StructField("restart_identity", T.BooleanType()),
        T.StructField("commit_lsn", T.LongType()),
        T.StructField("end_lsn", T.LongType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type_oid", T.LongType()),
        T.StructField("origin_lsn", T.LongType()),
        T.StructField("replica_identity", T.StringType()),
        T.StructField("columns", COLUMNS),
        T.StructField("raw", T.BinaryType()),
    ]
)

RELATIONS = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("replica_identity", T.StringType()),
        T.StructField("columns", COLUMNS),
    ]
)

SEGMENTS = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("segment_id", T.LongType()),
        T.StructField("min_lsn", T.LongType()),
        T.StructField("max_lsn", T.LongType()),
        T.StructField("min_ts", T.TimestampType()),
        T.StructField("max_ts", T.TimestampType()),
        T.StructField("messages", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("checksum", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)

SNAPSHOTS = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("start_lsn", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("relation", RELATIONS),
        T.StructField("path", T.StringType()),
    ]
)

NAME_HISTORY = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("next_lsn", T.LongType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

TABLE_STATE = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("messages_since_base", T.LongType()),
        T.StructField("deltas_since_base", T.LongType()),
        T.StructField("last_message_ts", T.TimestampType()),
        T.StructField("final_lsn", T.LongType()),
        T.StructField("flush_lsn", T.LongType()),
        T.StructField("base_lsn", T.LongType()),
    ]
)
