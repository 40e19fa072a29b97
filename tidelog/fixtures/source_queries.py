"""Queries that encode the given tables to binary messages or COPY text and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import tables as t
from tidelog.fixtures import wire
from tidelog.fixtures.catalog_queries import INSPECT_SQL
from tidelog.fixtures.oracles import with_fixtures
from tidelog.fixtures.registry import query
from tidelog.functions.cells import text_cell
from tidelog.operators import segments, transactions
from tidelog.operators.scan import RowNumber, ordered_scan
from tidelog.plans import jobs
from tidelog.session import cut_lineage, scratch_dir
from tidelog.sources import copytext, datasource, store
from tidelog.sources.segments import list_segments, read_frames, read_headers, split_frames, write_segment_files
from tidelog.sources.wire import decode_control, decode_messages, message_type
from tidelog.streaming import live

FRAMES_PER_SEGMENT = 50


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """The change log as binary messages."""
    return t.with_raw(t.messages(t.chg(spark, sf))).select("relation_oid", "pos", "raw")


def written_segments(spark: SparkSession, sf: str) -> str:
    """Folder of segment files with the change log as binary messages."""
    root = scratch_dir(spark, "segments")
    log = transactions.stitch_transactions(t.with_raw(t.messages(t.chg(spark, sf))))
    cut_lineage(write_segment_files(cut_lineage(segments.segment_by_count(log, FRAMES_PER_SEGMENT)), root))
    return root


_SEGMENTED = f"""(SELECT relation_oid, pos, msg_type, final_lsn, commit_us, CAST(floor((rn - 1) / {FRAMES_PER_SEGMENT}) AS BIGINT) AS segment_id, (rn - 1) % {FRAMES_PER_SEGMENT} AS frame_no
FROM (SELECT *, row_number() OVER (PARTITION BY relation_oid ORDER BY pos) AS rn FROM messages) n)"""


@query(
    "segment_scan",
    with_fixtures(
        "messages",
        body=f"""SELECT s.relation_oid, s.segment_id, s.frame_no, s.msg_type, h.messages, h.min_lsn, h.max_lsn
FROM {_SEGMENTED} s JOIN (SELECT relation_oid, segment_id, count(*) AS messages, min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn
  FROM {_SEGMENTED} q GROUP BY relation_oid, segment_id) h ON h.relation_oid = s.relation_oid AND h.segment_id = s.segment_id""",
    ),
)
def segment_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Segment files written from the log, listed and read again: header and frames."""
    files = cut_lineage(read_headers(list_segments(spark, written_segments(spark, sf))))  # headers are read once
    numbered = ordered_scan(files, ["relation_oid"], ["min_lsn", "postfix"], [RowNumber("__n")], levels=2)
    numbered = numbered.withColumn("segment_id", F.col("__n") - 1).drop("__n")
    frames = read_frames(numbered.select("relation_oid", "segment_id", "messages", "min_lsn", "max_lsn", "path", "length"))
    return frames.select(
        "relation_oid", "segment_id", "frame_no", message_type(F.col("raw")).alias("msg_type"), "messages", "min_lsn", "max_lsn"
    )


@query(
    "segment_files",
    with_fixtures(
        "messages",
        body=f"""SELECT relation_oid, CASE WHEN postfix = 0 THEN printf('%016x', min_lsn) ELSE printf('%016x', min_lsn) || '.' || postfix END AS segment_name,
       min_lsn, postfix, max_lsn, messages
FROM (SELECT *, row_number() OVER (PARTITION BY relation_oid, min_lsn ORDER BY segment_id) - 1 AS postfix
      FROM (SELECT relation_oid, segment_id, min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn, count(*) AS messages
            FROM {_SEGMENTED} s GROUP BY relation_oid, segment_id) h) p""",
    ),
)
def segment_files(spark: SparkSession, sf: str) -> DataFrame:
    """The same files by name and header; their frames are not read."""
    files = read_headers(list_segments(spark, written_segments(spark, sf)))
    return files.select("relation_oid", "segment_name", "min_lsn", "postfix", "max_lsn", "messages")


@query(
    "segment_stream",
    with_fixtures("messages", body="SELECT relation_oid, row_number() OVER (PARTITION BY relation_oid ORDER BY pos) AS n, msg_type, k FROM messages"),
)
def segment_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same files through the streaming data source, whose offsets are files and bytes."""
    datasource.register(spark)
    work = scratch_dir(spark, "stream")
    stream = spark.readStream.format("tidelog_segments").load(written_segments(spark, sf))
    live.write_append(stream.select("relation_oid", "pos", "raw"), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    decoded = decode_messages(spark.read.parquet(f"{work}/out"))
    ordered = ordered_scan(decoded, ["relation_oid"], ["pos"], [RowNumber("n")], levels=2)
    return ordered.select("relation_oid", "n", "msg_type", _cell_columns()[0])


@query(
    "inspect_segments",
    with_fixtures("messages", body=f"SELECT relation_oid, row_number() OVER (PARTITION BY relation_oid ORDER BY pos) AS n, line FROM ({INSPECT_SQL}) i"),
)
def inspect_segments(spark: SparkSession, sf: str) -> DataFrame:
    """From segment files to lines that describe their messages, in the order of the log."""
    lines = jobs.inspect(spark, written_segments(spark, sf))
    return ordered_scan(lines, ["relation_oid"], ["pos"], [RowNumber("n")], levels=2).select("relation_oid", "n", "line")


def _cell_columns():
    new = [F.get("new_row", F.lit(i)) for i in range(3)]
    return [
        F.coalesce(new[0]["value"], F.get("ident", F.lit(0))["value"]).cast("bigint").alias("k"),
        new[1]["kind"].alias("value_kind"),
        new[1]["value"].alias("value"),
        new[2]["kind"].alias("props_kind"),
        new[2]["value"].alias("props"),
    ]


@query(
    "decode_roundtrip",
    with_fixtures("messages", body="SELECT relation_oid, pos, msg_type, k, value_kind, value, props_kind, props FROM messages WHERE k IS NOT NULL"),
)
def decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_messages(encoded(spark, sf))
    return decoded.where("msg_type in ('insert', 'update', 'delete')").select(
        "relation_oid", "pos", "msg_type", *_cell_columns()
    )


@query(
    "decode_begin",
    with_fixtures("messages", body="SELECT relation_oid, pos, final_lsn, xid, commit_us FROM messages WHERE msg_type = 'begin'"),
)
def decode_begin(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_control(encoded(spark, sf)).where("msg_type = 'begin'")
    return decoded.select("relation_oid", "pos", "final_lsn", "xid", F.unix_micros("commit_ts").alias("commit_us"))


@query(
    "decode_commit",
    with_fixtures(
        "messages",
        body="SELECT relation_oid, pos, 0 AS flags, final_lsn AS commit_lsn, final_lsn + 1 AS end_lsn, own_us AS commit_us FROM messages WHERE msg_type = 'commit'",
    ),
)
def decode_commit(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_control(encoded(spark, sf)).where("msg_type = 'commit'")
    return decoded.select(
        "relation_oid", "pos", "flags", "commit_lsn", "end_lsn", F.unix_micros("commit_ts").alias("commit_us")
    )


@query("decode_origin", "SELECT o_orderkey AS id, o_orderkey + 1 AS origin_lsn, o_orderpriority AS name FROM orders")
def decode_origin(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), wire.origin(F.col("o_orderkey") + 1, F.col("o_orderpriority")).alias("raw")
    )
    return decode_control(rows).select("id", "origin_lsn", "name")


@query("decode_type", "SELECT p_partkey AS type_oid, p_brand AS namespace, p_name AS name FROM part")
def decode_type(spark: SparkSession, sf: str) -> DataFrame:
    raw = wire.type_(F.col("p_partkey"), F.col("p_brand"), F.col("p_name"))
    return decode_control(t.table(spark, sf, "part").select(raw.alias("raw"))).select("type_oid", "namespace", "name")


@query(
    "decode_relation",
    """SELECT p_partkey AS relation_oid, p_brand AS namespace, p_name AS name, substr('dnif', CAST(p_size % 4 AS INTEGER) + 1, 1) AS replica_identity,
 2 AS n_columns, p_type || ',b' AS names, p_size % 2 = 0 AS first_is_key, p_size AS first_type, -1 AS first_typmod, 1700 AS second_type, p_size + 4 AS second_typmod FROM part""",
)
def decode_relation(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("bigint")
    columns = F.array(
        F.struct((size % 2 == 0).alias("is_key"), F.col("p_type").alias("name"), size.alias("type_oid"), F.lit(-1).alias("typmod")),
        F.struct(F.lit(False).alias("is_key"), F.lit("b").alias("name"), F.lit(1700).cast("bigint").alias("type_oid"), (F.col("p_size") + 4).alias("typmod")),
    )
    identity = F.element_at(F.array(*[F.lit(c) for c in "dnif"]), F.col("p_size") % 4 + 1)
    raw = wire.relation(F.col("p_partkey"), F.col("p_brand"), F.col("p_name"), identity, columns)
    decoded = decode_messages(t.table(spark, sf, "part").select(raw.alias("raw")))
    first, second = F.get("columns", F.lit(0)), F.get("columns", F.lit(1))
    return decoded.select(
        "relation_oid",
        "namespace",
        "name",
        "replica_identity",
        F.size("columns").alias("n_columns"),
        F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("names"),
        first["is_key"].alias("first_is_key"),
        first["type_oid"].alias("first_type"),
        first["typmod"].alias("first_typmod"),
        second["type_oid"].alias("second_type"),
        second["typmod"].alias("second_typmod"),
    )


@query(
    "decode_insert",
    "SELECT doc_id, 4242 AS relation_oid, md5(text) AS text_md5, length(text) AS n, 't' AS text_kind, CASE WHEN lang = 'en' THEN 'n' ELSE 't' END AS lang_kind, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang FROM documents",
)
def decode_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, with line breaks and non-ASCII text, as row images."""
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    row = F.array(text_cell(F.col("doc_id")), text_cell(F.col("text")), text_cell(lang))
    rows = t.table(spark, sf, "documents").select("doc_id", wire.insert(F.lit(4242), row).alias("raw"))
    text, language = F.get("new_row", F.lit(1)), F.get("new_row", F.lit(2))
    return decode_messages(rows).select(
        "doc_id",
        "relation_oid",
        F.md5(text["value"]).alias("text_md5"),
        F.length(text["value"]).alias("n"),
        text["kind"].alias("text_kind"),
        language["kind"].alias("lang_kind"),
        language["value"].alias("lang"),
    )


@query(
    "decode_update",
    """SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS ident_is_key,
 CASE o_orderkey % 3 WHEN 1 THEN o_orderkey + 1000000 WHEN 2 THEN o_orderkey END AS old_key,
 CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS old_priority, o_orderkey AS new_key,
 CASE WHEN o_orderstatus = 'P' THEN 'n' ELSE 't' END AS status_kind, CASE WHEN o_orderkey % 5 = 0 THEN 'u' ELSE 't' END AS priority_kind,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders""",
)
def decode_update(spark: SparkSession, sf: str) -> DataFrame:
    raw = wire.update(F.col("relation_oid"), F.col("ident"), F.col("ident_is_key"), F.col("new_row"))
    decoded = decode_messages(t.order_updates(spark, sf).select("pos", raw.alias("raw")))

    def at(side: str, i: int):
        return F.get(side, F.lit(i))

    return decoded.select(
        "pos",
        "ident_is_key",
        at("ident", 0)["value"].cast("bigint").alias("old_key"),
        at("ident", 2)["value"].alias("old_priority"),
        at("new_row", 0)["value"].cast("bigint").alias("new_key"),
        at("new_row", 1)["kind"].alias("status_kind"),
        at("new_row", 2)["kind"].alias("priority_kind"),
        at("new_row", 2)["value"].alias("priority"),
    )


@query("decode_delete", with_fixtures("chg", body="SELECT relation_oid, lsn * 100 AS pos, true AS ident_is_key, k, 'n' AS rest_kind FROM chg WHERE op = 'D'"))
def decode_delete(spark: SparkSession, sf: str) -> DataFrame:
    decoded = decode_messages(encoded(spark, sf)).where("msg_type = 'delete'")
    return decoded.select(
        "relation_oid",
        "pos",
        "ident_is_key",
        F.get("ident", F.lit(0))["value"].cast("bigint").alias("k"),
        F.get("ident", F.lit(1))["kind"].alias("rest_kind"),
    )


@query(
    "decode_truncate",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_custkey || ',' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS oids,
 o_orderkey % 2 = 0 AS cascade, o_orderkey % 3 = 0 AS restart_identity FROM orders""",
)
def decode_truncate(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    oids = F.when(F.col("o_orderstatus") == "P", F.array(F.col("o_custkey"), key)).otherwise(F.array("o_custkey"))
    raw = wire.truncate(oids, key % 2 == 0, key % 3 == 0)
    decoded = decode_control(t.table(spark, sf, "orders").select(key.alias("id"), raw.alias("raw")))
    joined = F.array_join(F.transform("relation_oids", lambda o: o.cast("string")), ",")
    return decoded.select("id", joined.alias("oids"), "cascade", "restart_identity")


@query(
    "decode_corrupt",
    "SELECT doc_id, doc_id % 3 <> 0 AS corrupt, CASE WHEN doc_id % 3 = 0 THEN length(text) END AS n FROM documents",
)
def decode_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """A third intact, a third cut short, a third of an unknown type; all are kept."""
    row = F.array(text_cell(F.col("doc_id")), text_cell(F.col("text")))
    whole = F.hex(wire.insert(F.lit(4242), row))
    cut = F.substr(whole, F.lit(1), F.length(whole) - 2)
    unknown = F.concat(F.lit("5A"), whole)
    kind = F.col("doc_id") % 3
    raw = F.unhex(F.when(kind == 0, whole).when(kind == 1, cut).otherwise(unknown))
    rows = t.table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    decoded = decode_messages(rows, mode="PERMISSIVE")
    return decoded.select(
        "doc_id", F.col("_corrupt").alias("corrupt"), F.length(F.get("new_row", F.lit(1))["value"]).alias("n")
    )


_DOC_COLUMNS = [
    {"name": "doc_id", "type_oid": 20, "typmod": -1},
    {"name": "text", "type_oid": 25, "typmod": -1},
    {"name": "lang", "type_oid": 25, "typmod": -1},
    {"name": "n_chars", "type_oid": 20, "typmod": -1},
]


@query(
    "copy_text_roundtrip",
    "SELECT doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang, n_chars FROM documents",
)
def copy_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to a COPY text file and back."""
    path = scratch_dir(spark, "copy")
    docs = t.table(spark, sf, "documents")
    line = copytext.copy_line(
        F.col("doc_id"), F.col("text"), F.when(F.col("lang") != "en", F.col("lang")), F.col("n_chars")
    )
    docs.select(line.alias("value")).write.text(path)
    return copytext.read_copy_text(spark, path, _DOC_COLUMNS)


@query(
    "copy_text_corrupt",
    """SELECT CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey END AS id,
       CASE WHEN o_orderkey % 7 > 1 AND o_orderkey % 11 > 0 THEN o_custkey END AS custkey,
       CASE WHEN o_orderkey % 7 > 1 THEN o_orderstatus END AS status,
       CASE o_orderkey % 7 WHEN 0 THEN concat_ws(chr(9), o_orderkey, o_custkey)
                           WHEN 1 THEN concat_ws(chr(9), o_orderkey, o_custkey, o_orderstatus, 'more') END AS corrupt_line,
       CASE WHEN o_orderkey % 7 > 1 AND o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS cast_errors
FROM orders""",
)
def copy_text_corrupt(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a field too few or too many, and texts that are no number, are told."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    line = (
        F.when(key % 7 == 0, copytext.copy_line(key, customer))
        .when(key % 7 == 1, copytext.copy_line(key, customer, F.col("o_orderstatus"), F.lit("more")))
        .otherwise(copytext.copy_line(key, F.when(key % 11 == 0, F.lit("z")).otherwise(customer), F.col("o_orderstatus")))
    )
    path = scratch_dir(spark, "copy")
    t.table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    columns = [{"name": n, "type_oid": o, "typmod": -1} for n, o in (("id", 20), ("custkey", 20), ("status", 25))]
    rows = copytext.read_copy_text(spark, path, columns, mode="PERMISSIVE")
    return rows.withColumnsRenamed({"_corrupt_line": "corrupt_line", "_cast_errors": "cast_errors"})


@query(
    "segment_torn",
    """SELECT o_orderkey AS id, f.frame_no, CASE WHEN f.frame_no = 2 THEN NULL ELSE 'insert' END AS msg_type, f.frame_no = 2 AS corrupt
FROM orders, (SELECT unnest([0, 1, 2]) AS frame_no) f""",
)
def segment_torn(spark: SparkSession, sf: str) -> DataFrame:
    """Three messages per segment, the last one cut off: it is kept and marked."""
    message = wire.insert(F.col("o_orderkey"), F.array(text_cell(F.col("o_orderkey")), text_cell(F.col("o_orderpriority"))))
    frame = F.concat(F.unhex(F.lpad(F.hex((F.octet_length("raw") + 8).cast("bigint")), 16, "0")), F.col("raw"))
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), message.alias("raw")).withColumn("frame", frame)
    whole = F.concat(F.unhex(F.lit("00" * 40)), "frame", "frame", "frame")
    torn = orders.select("id", F.substring(whole, F.lit(1), F.octet_length(whole) - 3).alias("content"))
    decoded = decode_messages(split_frames(torn, mode="PERMISSIVE"), mode="PERMISSIVE")
    return decoded.select("id", "frame_no", F.when(~F.col("_corrupt"), F.col("msg_type")).alias("msg_type"), F.col("_corrupt").alias("corrupt"))


@query(
    "latest_snapshot",
    """SELECT o_custkey AS relation_oid, max(o_orderkey + 1) AS start_lsn, arg_max(o_orderpriority, o_orderkey) AS name
FROM orders WHERE o_orderkey + 1 <= (SELECT count(*) FROM orders) / 2 GROUP BY o_custkey""",
)
def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Every order stands for a snapshot of its customer's table; the first half of the log."""
    orders = t.table(spark, sf, "orders")
    snapshots = orders.select(
        F.col("o_custkey").alias("relation_oid"),
        (F.col("o_orderkey") + 1).alias("start_lsn"),
        F.col("o_orderpriority").alias("name"),
    )
    return store.latest_snapshots(snapshots, orders.count() // 2)


@query(
    "segment_listing",
    with_fixtures(
        "stitched",
        body=f"""SELECT relation_oid, segment_id, min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn, count(*) AS messages
FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY relation_oid ORDER BY pos) - 1) / {FRAMES_PER_SEGMENT}) AS BIGINT) AS segment_id FROM stitched) s
GROUP BY relation_oid, segment_id""",
    ),
)
def segment_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Segments stored in an archive, listed again from its manifest."""
    root = scratch_dir(spark, "archive")
    log = transactions.stitch_transactions(t.chg_ctl(t.chg(spark, sf)))
    store.write_segments(segments.segment_by_count(log, FRAMES_PER_SEGMENT), root)
    manifest = store.read_segment_manifest(spark, root)
    return manifest.select("relation_oid", "segment_id", "min_lsn", "max_lsn", "messages")
