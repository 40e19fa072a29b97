"""Queries that run whole jobs: archive, restore, compaction, promotion, streaming ingest.

Each builds its archive in a new shared scratch folder from the change log of the given
tables and reads the result back.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import tables as t
from tidelog.fixtures.catalog_queries import INSPECT_SQL, publication
from tidelog.fixtures.oracles import with_fixtures
from tidelog.fixtures.registry import ORACLES, QUERIES, query
from tidelog.functions.cells import cell, text_cell
from tidelog.functions.lsn import as_micros
from tidelog.operators import catalog, segments, transactions
from tidelog.operators.scan import RowNumber, ordered_scan
from tidelog.plans import jobs
from tidelog.schema import CHANGES
from tidelog.session import cut_lineage, scratch_dir
from tidelog.sources import commits, store
from tidelog.sources.segments import write_segment_files
from tidelog.streaming import ingest as ing
from tidelog.streaming import image, live

MESSAGES_PER_SEGMENT = 200
FILES = 6
#: Bytes of a row group of a landed file.
ROW_GROUP = 16 << 20


def archive(spark: SparkSession, sf: str) -> str:
    """The change log, stored as one batch, with its name history."""
    root = scratch_dir(spark, "archive")
    log = t.chg(spark, sf)
    ing.store_batch(cut_lineage(t.messages(log)), 0, root, MESSAGES_PER_SEGMENT)
    store.write_name_history(catalog.name_changes(t.relations(log)), root)
    return root


def _tables(spark: SparkSession, root: str) -> list:
    """Schemas of the archived tables: metadata, one row per table."""
    return catalog.latest_relations(jobs.relations_of(store.read_changes(spark, root))).orderBy("relation_oid").collect()


def _union(parts: Iterator[DataFrame]) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def _restored(spark: SparkSession, root: str, tables: list | None = None, **options) -> DataFrame:
    """All tables of the archive (or the given ones), restored one by one."""
    return _union(
        jobs.restore_table(spark, root, r["relation_oid"], **options).rows.withColumn(
            "relation_oid", F.lit(r["relation_oid"])
        )
        for r in tables or _tables(spark, root)
    )


_BY_OID = "SELECT relation_oid, k, value, props FROM {image}"


@query("restore_table", with_fixtures("done_image", body=_BY_OID.format(image="done_image")))
def restore_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every table by name, from a first snapshot and the changes after it."""
    root = archive(spark, sf)
    tables = _tables(spark, root)
    half = store.read_changes(spark, root).agg(F.max("final_lsn")).first()[0] // 2
    for r in tables:
        jobs.compact(spark, root, r["relation_oid"], half)
    return _union(
        jobs.restore(spark, root, r["namespace"], r["name"]).withColumn("relation_oid", F.lit(r["relation_oid"]))
        for r in tables
    )


_AT = "(SELECT CAST(max(xid) / 2 AS BIGINT) * 8 FROM chg)"
_IMAGE_AT = f"""(SELECT a.relation_oid, a.k, v.value, p.props
FROM (SELECT relation_oid, k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv, max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp
      FROM done WHERE final_lsn <= (SELECT max(final_lsn) FROM done) // 2 GROUP BY relation_oid, k) a
JOIN done v ON v.lsn = a.mv JOIN done p ON p.lsn = a.mp
WHERE a.li > coalesce(a.ld, 0))"""


def _half(spark: SparkSession, root: str) -> int:
    commits = store.read_changes(spark, root).where("msg_type = 'commit'")
    return commits.agg(F.max("final_lsn")).first()[0] // 2


@query("restore_at_lsn", with_fixtures("done", body=f"SELECT * FROM {_IMAGE_AT} i"))
def restore_at_lsn(spark: SparkSession, sf: str) -> DataFrame:
    root = archive(spark, sf)
    return _restored(spark, root, at_lsn=_half(spark, root))


@query("compact", with_fixtures("done", body=f"SELECT * FROM {_IMAGE_AT} i"))
def compact(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots made by replaying the log up to its middle, read back by their manifest."""
    root = archive(spark, sf)
    half = _half(spark, root)
    for r in _tables(spark, root):
        jobs.compact(spark, root, r["relation_oid"], half)
    return _snapshots(spark, root)


@query("purge", with_fixtures("done_image", body=_BY_OID.format(image="done_image")))
def purge(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, snapshots at the end of the first, a real purge of it: restores do not change."""
    root = scratch_dir(spark, "archive")
    changes = t.chg(spark, sf)
    log = cut_lineage(t.messages(changes))
    cut = (changes.agg(F.max("final_lsn")).first()[0] or 0) // 16 * 8
    first = F.col("pos") <= cut * 100 + 50
    for batch, rows in enumerate((log.where(first), log.where(~first))):
        ing.store_batch(rows, batch, root, MESSAGES_PER_SEGMENT)
    tables = _tables(spark, root)
    for r in tables:
        jobs.compact(spark, root, r["relation_oid"], cut)
    gone = jobs.purge(spark, root, dry_run=False)
    if gone.count() != len(tables):
        raise ValueError("every table's first batch is superseded and must go")
    # The first schema messages are gone with it; the snapshots hold the schema now.
    return _restored(spark, root, tables)


@query("table_state_stored", ORACLES["table_state"])
def table_state_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The state of all tables: half of it archived over an older version, the rest staged over archived rows."""
    staging, root = scratch_dir(spark, "staging"), scratch_dir(spark, "archive")
    current = cut_lineage(QUERIES["table_state"](spark, sf))
    older = current.select(*[
        (F.col(c) if c == "relation_oid" else F.lit(None).cast(kind)).alias(c) for c, kind in current.dtypes
    ])
    store.write_table_state(older, root)
    store.write_table_state(current.where("relation_oid % 2 = 0"), root)
    store.write_table_state(current.where("relation_oid % 2 = 1"), staging)
    return store.read_table_state(spark, staging, root)


def _snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the newest snapshot of every table, through the manifest."""
    rows = store.latest_snapshots(store.read_snapshots(spark, root)).collect()
    return _union(store.read_snapshot(spark, r).withColumn("relation_oid", F.lit(r["relation_oid"])) for r in rows)


@query("snapshot_write", with_fixtures("done_image", body=_BY_OID.format(image="done_image")))
def snapshot_write(spark: SparkSession, sf: str) -> DataFrame:
    root = archive(spark, sf)
    for r in _tables(spark, root):
        restored = jobs.restore_table(spark, root, r["relation_oid"])
        store.write_snapshot(restored.rows, restored.relation, _half(spark, root), root)
    return _snapshots(spark, root)


@query(
    "restore_append",
    with_fixtures(
        "done",
        "done_image",
        body=f"""SELECT relation_oid, k, value, props, count(*) AS n
FROM (SELECT relation_oid, k, value, props FROM done_image UNION ALL SELECT * FROM {_IMAGE_AT} i) u GROUP BY relation_oid, k, value, props""",
    ),
)
def restore_append(spark: SparkSession, sf: str) -> DataFrame:
    """The table as of the middle of the log, replaced; then its latest state, appended."""
    root = archive(spark, sf)
    half = _half(spark, root)

    def both(r) -> DataFrame:
        target = f"{root}/restored/{r['relation_oid']}"
        jobs.restore(spark, root, r["namespace"], r["name"], target, mode="overwrite", at_lsn=half)
        rows = jobs.restore(spark, root, r["namespace"], r["name"], target, mode="append")
        return rows.withColumn("relation_oid", F.lit(r["relation_oid"]))

    rows = _union(both(r) for r in _tables(spark, root))
    return rows.groupBy("relation_oid", "k", "value", "props").agg(F.count("*").alias("n"))


@query(
    "restore_uncastable",
    """SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'infinity' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ordered,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS customer,
       (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0) AS uncastable FROM orders""",
)
def restore_uncastable(spark: SparkSession, sf: str) -> DataFrame:
    """A column with dates that Spark cannot hold is restored as text and reported."""
    root = scratch_dir(spark, "archive")
    key = F.col("o_orderkey")
    rows = t.table(spark, sf, "orders").select(
        key.alias("id"),
        F.when(key % 5 == 0, "infinity").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ordered"),
        F.when(key % 9 > 0, F.col("o_custkey")).alias("customer"),
    )
    columns = [
        {"is_key": True, "name": "id", "type_oid": 20, "typmod": -1},
        {"is_key": False, "name": "ordered", "type_oid": 1082, "typmod": -1},
        {"is_key": False, "name": "customer", "type_oid": 20, "typmod": -1},
    ]
    relation = spark.range(1).select(
        F.lit(1).cast("bigint").alias("relation_oid"), F.lit(1).cast("bigint").alias("lsn"), F.lit("public").alias("namespace"),
        F.lit("orders").alias("name"), F.lit("d").alias("replica_identity"), t.columns_literal(columns).alias("columns"),
    ).first()
    store.write_snapshot(rows, relation, 8, root)
    restored = jobs.restore_table(spark, root, 1)
    return restored.rows.withColumn("uncastable", F.lit(restored.uncastable["ordered"]).cast("bigint"))


@query(
    "initial_base",
    """SELECT n_nationkey AS relation_oid, c_custkey, c_name, c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE n_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey
                      HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)))""",
)
def initial_base(spark: SparkSession, sf: str) -> DataFrame:
    """A first snapshot of every published table; the customers of a nation are its rows."""
    root = scratch_dir(spark, "archive")
    customers = t.table(spark, sf, "customer")
    columns = t.columns_literal(
        [
            {"is_key": True, "name": "c_custkey", "type_oid": 20, "typmod": -1},
            {"is_key": False, "name": "c_name", "type_oid": 25, "typmod": -1},
            {"is_key": False, "name": "c_mktsegment", "type_oid": 25, "typmod": -1},
        ]
    )
    relations = publication(spark, sf).select(
        F.col("oid").cast("bigint").alias("relation_oid"),
        F.lit(1).cast("bigint").alias("lsn"),
        F.col("nspname").alias("namespace"),
        F.col("relname").alias("name"),
        "replica_identity",
        columns.alias("columns"),
    )

    def rows(relation) -> DataFrame:
        own = customers.where(F.col("c_nationkey") == relation["relation_oid"])
        return own.select("c_custkey", "c_name", "c_mktsegment")

    jobs.initial_base(spark, relations.collect(), rows, 1, root)
    return _snapshots(spark, root)


@query(
    "promote_audit",
    with_fixtures(
        "stitched",
        "base",
        body="""SELECT s.relation_oid, s.segment_id, s.n AS source_rows, s.n AS target_rows, true AS ok
FROM (SELECT relation_oid, segment_id, count(*) AS n, max(final_lsn) AS max_lsn
      FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY relation_oid ORDER BY pos) - 1) / 50) AS BIGINT) AS segment_id FROM stitched) c
      GROUP BY relation_oid, segment_id) s JOIN base b ON b.relation_oid = s.relation_oid WHERE s.max_lsn > b.start_lsn""",
    ),
)
def promote_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Staged segments that the base does not supersede move to the archive, audited."""
    staging, target = scratch_dir(spark, "staging"), scratch_dir(spark, "archive")
    log = t.chg(spark, sf)
    stitched = transactions.stitch_transactions(t.chg_ctl(log))
    store.write_segments(segments.segment_by_count(stitched, 50), staging)
    audit = jobs.promote_segments(spark, staging, target, t.base(log))
    return audit.select("relation_oid", "segment_id", "source_rows", "target_rows", "ok")


# --- streaming -----------------------------------------------------------------------------


def land(spark: SparkSession, log: DataFrame, landing: str, parts: int = FILES) -> None:
    """The log as landed files, in log order, one file per slice of positions.

    One job writes all slices, each in a task of its own. Files are taken by their times, so those are
    set in the order of the slices. Row groups are small, so that many tasks read a file."""
    log = cut_lineage(log)
    top = log.agg(F.max("pos")).first()[0] + 1
    sliced = log.withColumn("__slice", (F.col("pos") * parts / F.lit(top)).cast("int")).where(F.col("__slice").between(0, parts - 1))
    draft = scratch_dir(spark, "slices")
    sliced.repartitionById(parts, "__slice").withColumn("__part", F.col("__slice")).drop("__slice").write.option(
        "parquet.block.size", ROW_GROUP).partitionBy("__part").parquet(draft)
    files, target = commits._hadoop(spark, landing)
    files.mkdirs(target)
    path = lambda name: commits._hadoop(spark, name)[1]
    # One file per slice: metadata.
    found = [s.getPath() for i in range(parts) if files.exists(path(f"{draft}/__part={i}")) for s in files.listStatus(path(f"{draft}/__part={i}"))]
    found = [f for f in found if f.getName().endswith(".parquet")]
    now = int(time.time() * 1000)
    for at, f in enumerate(found):
        files.setTimes(f, now + at, -1)
        if not files.rename(f, path(f"{landing}/{f.getName()}")):
            raise ValueError(f"{f} did not land")


def _ingested(spark: SparkSession, sf: str, **options) -> tuple[str, str]:
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    land(spark, t.messages(t.chg(spark, sf)), landing)
    run = ing.ingest(spark, landing, root, f"{root}/checkpoint", max_files=2, messages_per_segment=MESSAGES_PER_SEGMENT, **options)
    run.awaitTermination()
    return landing, root


_STORED = "SELECT relation_oid, pos, msg_type, xid, final_lsn, commit_us FROM messages"


def _stored(spark: SparkSession, root: str) -> DataFrame:
    return store.read_changes(spark, root).select(
        "relation_oid", "pos", "msg_type", "xid", "final_lsn", F.unix_micros("commit_ts").alias("commit_us")
    )


@query("stream_ingest", with_fixtures("messages", body=_STORED))
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions are cut by batch borders and stitched across them."""
    _, root = _ingested(spark, sf)
    return _stored(spark, root)


_ORDINAL = "row_number() OVER (PARTITION BY relation_oid ORDER BY pos) AS n"


def _landed_binary(spark: SparkSession, log: DataFrame, whole_log: bool, parts: int = 3) -> str:
    """An encoded log as segment files that land in ``parts`` instalments, each ingested when it is there.

    Instalments end inside transactions. Only messages are counted, so files of a later one
    never come before files of an earlier one. Files of the whole log are taken by name."""
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    stitched = transactions.stitch_transactions(cut_lineage(log))
    cut = cut_lineage(segments.segment_by_count(stitched, MESSAGES_PER_SEGMENT // 4))
    last = cut.agg(F.max("segment_id")).first()[0] or 0
    for i in range(parts):
        low, high = ((last + 1) * k // parts for k in (i, i + 1))
        own = (F.col("segment_id") >= low) & (F.col("segment_id") < high)
        cut_lineage(write_segment_files(cut, landing, own))
        run = ing.ingest(spark, landing, root, f"{root}/checkpoint", binary=True, messages_per_segment=MESSAGES_PER_SEGMENT, whole_log=whole_log, by_name=whole_log)
        run.awaitTermination()
    return root


def _stored_in_order(spark: SparkSession, root: str) -> DataFrame:
    rows = ordered_scan(store.read_changes(spark, root), ["relation_oid"], ["pos"], [RowNumber("n")], levels=2)
    return rows.select("relation_oid", "n", "msg_type", "xid", "final_lsn", F.unix_micros("commit_ts").alias("commit_us"))


@query(
    "stream_ingest_binary",
    with_fixtures("messages", body=f"SELECT relation_oid, {_ORDINAL}, msg_type, xid, final_lsn, commit_us FROM messages"),
)
def stream_ingest_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Segment files of every table, read by byte range as they land."""
    return _stored_in_order(spark, _landed_binary(spark, t.with_raw(t.messages(t.chg(spark, sf))), whole_log=False))


@query(
    "stream_whole_log",
    with_fixtures(
        "chg",
        body=f"""SELECT relation_oid, {_ORDINAL}, msg_type, m.xid, m.final_lsn, us AS commit_us
FROM (SELECT relation_oid, lsn * 100 AS pos, CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END AS msg_type, xid, final_lsn FROM chg
      UNION ALL SELECT relation_oid, min(lsn) * 100 - 40, 'begin', xid, final_lsn FROM chg GROUP BY relation_oid, xid, final_lsn
      UNION ALL SELECT relation_oid, max(lsn) * 100 + 50, 'commit', xid, final_lsn FROM chg WHERE xid < (SELECT max(xid) FROM chg) GROUP BY relation_oid, xid, final_lsn
      UNION ALL SELECT 0, min(lsn) * 100 - 40, 'begin', xid, final_lsn FROM chg GROUP BY xid, final_lsn
      UNION ALL SELECT 0, max(lsn) * 100 + 50, 'commit', xid, final_lsn FROM chg WHERE xid < (SELECT max(xid) FROM chg) GROUP BY xid, final_lsn
      UNION ALL SELECT relation_oid, min(lsn) * 100 - 20, 'relation', arg_min(xid, lsn), arg_min(final_lsn, lsn) FROM chg GROUP BY relation_oid) m
JOIN (SELECT xid, final_lsn, epoch_us(max(ts)) AS us FROM chg GROUP BY xid, final_lsn) x ON x.xid = m.xid AND x.final_lsn = m.final_lsn""",
    ),
)
def stream_whole_log(spark: SparkSession, sf: str) -> DataFrame:
    """Segment files of the log itself: one begin and one commit per transaction, routed to its tables."""
    changes = t.chg(spark, sf)
    log = t.messages(changes)
    # The same messages with the control messages of the whole log.
    whole = t.messages(changes.withColumn("relation_oid", F.lit(0).cast("bigint"))).where("msg_type in ('begin', 'commit')")
    rows = log.where("msg_type not in ('begin', 'commit')").unionByName(whole)
    return _stored_in_order(spark, _landed_binary(spark, _as_one_stream(rows), whole_log=True))


def _as_one_stream(rows: DataFrame) -> DataFrame:
    """Messages encoded with their own relations, in one stream, that of relation 0."""
    return t.with_raw(rows).withColumn("relation_oid", F.lit(0).cast("bigint"))


@query("merge_batches", with_fixtures("done_image", body=_BY_OID.format(image="done_image")))
def merge_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Many small batches become few directories; a restore after it reads those."""
    root = scratch_dir(spark, "archive")
    changes = t.chg(spark, sf)
    log = cut_lineage(t.messages(changes))
    top = log.agg(F.max("pos")).first()[0] + 1
    for batch in range(FILES):
        part = log.where((F.col("pos") >= top * batch // FILES) & (F.col("pos") < top * (batch + 1) // FILES))
        ing.store_batch(part, batch, root, MESSAGES_PER_SEGMENT)
    before = store.read_segment_manifest(spark, root).select("path").distinct().count()
    store.merge_batches(spark, root, fan=2)
    after = store.read_segment_manifest(spark, root).select("path").distinct().count()
    if after >= before:
        raise ValueError(f"{before} directories were not merged")
    return _restored(spark, root)


_FALLING = "CASE WHEN xid % 3 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END"


@query(
    "restore_at_ts",
    with_fixtures(
        "done",
        body=f"""SELECT a.relation_oid, a.k, v.value, p.props
FROM (SELECT d.relation_oid, k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv, max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp
      FROM done d LEFT JOIN (
          SELECT c.relation_oid, min(final_lsn) AS first FROM (SELECT relation_oid, final_lsn, max({_FALLING}) AS us FROM done GROUP BY relation_oid, final_lsn) c
          WHERE us > (SELECT max({_FALLING}) FROM done WHERE final_lsn <= (SELECT max(final_lsn) FROM done) // 2) GROUP BY c.relation_oid) f
        ON f.relation_oid = d.relation_oid
      WHERE f.first IS NULL OR d.final_lsn < f.first GROUP BY d.relation_oid, k) a
JOIN done v ON v.lsn = a.mv JOIN done p ON p.lsn = a.mp
WHERE a.li > coalesce(a.ld, 0)""",
    ),
)
def restore_at_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Tables as of a time, where commit times fall now and then: up to the first later commit."""
    root = scratch_dir(spark, "archive")
    falling = F.when(F.col("xid") % 3 == 0, F.col("ts") - F.expr("INTERVAL 2 HOURS")).otherwise(F.col("ts"))
    changes = cut_lineage(t.chg(spark, sf).withColumn("ts", falling))
    ing.store_batch(cut_lineage(t.messages(changes)), 0, root, MESSAGES_PER_SEGMENT)
    done = changes.where(F.col("xid") < changes.agg(F.max("xid")).first()[0])
    half = done.agg(F.max("final_lsn")).first()[0] // 2
    at = done.where(F.col("final_lsn") <= half).agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return _restored(spark, root, at_ts=at)


@query(
    "restore_rekeyed",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'm' ELSE 'c' END || o_orderkey AS code,
       CASE WHEN o_orderkey % 11 = 0 THEN 'moved' WHEN o_orderkey % 3 = 0 THEN 'later' WHEN o_orderkey % 5 = 0 THEN 'early' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 7 <> 0""",
)
def restore_rekeyed(spark: SparkSession, sf: str) -> DataFrame:
    """Inside one log the key of a table moves from one column to another; nothing has a snapshot."""
    root, oid, step = scratch_dir(spark, "archive"), 20001, 1 << 40
    orders = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    code = F.concat(F.lit("c"), F.col("id").cast("string"))
    same, none = cell(F.lit("u"), F.lit(None)), cell(F.lit("n"), F.lit(None))

    def rows(phase: int, chosen: str, msg_type: str, new_row=None, ident=None) -> DataFrame:
        fields = {"new_row": new_row, "ident": ident, "ident_is_key": None if ident is None else F.lit(True)}
        return orders.where(chosen).select(
            (F.lit(phase * step) + F.col("id")).alias("pos"), F.lit(msg_type).alias("msg_type"), *[v.alias(k) for k, v in fields.items() if v is not None]
        )

    def control(phase: int, msg_type: str, at: int, **fields) -> DataFrame:
        stamp = F.timestamp_seconds(F.lit(1_700_000_000 + phase))
        made = {"commit_ts": stamp, **{k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}}
        return spark.range(1).select(F.lit(phase * step + at).alias("pos"), F.lit(msg_type).alias("msg_type"), *[v.alias(k) for k, v in made.items()])

    def schema(phase: int, key: str) -> DataFrame:
        columns = [{"is_key": n == key, "name": n, "type_oid": o, "typmod": -1} for n, o in (("id", 20), ("code", 25), ("status", 25))]
        return control(phase, "relation", -2, namespace="public", name="orders", replica_identity="d", columns=t.columns_literal(columns)).drop("commit_ts")

    whole = lambda status: F.array(text_cell(F.col("id")), text_cell(code), status)
    moved = F.array(text_cell(F.col("id")), text_cell(F.concat(F.lit("m"), F.col("id").cast("string"))), text_cell(F.lit("moved")))
    by_code = F.array(none, text_cell(code), none)
    parts = [
        control(1, "begin", -3, xid=1, final_lsn=1000), schema(1, "id"), rows(1, "true", "insert", whole(text_cell(F.col("status")))),
        rows(2, "id % 5 = 0", "update", F.array(text_cell(F.col("id")), same, text_cell(F.lit("early")))),
        control(3, "commit", 0, commit_lsn=1000, end_lsn=1001, flags=0),
        control(4, "begin", -3, xid=2, final_lsn=2000), schema(4, "code"), rows(4, "id % 3 = 0", "update", F.array(same, text_cell(code), text_cell(F.lit("later")))),
        rows(5, "id % 7 = 0", "delete", ident=by_code), rows(6, "id % 11 = 0 and id % 7 <> 0", "update", moved, by_code),
        control(7, "commit", 0, commit_lsn=2000, end_lsn=2001, flags=0),
    ]
    log = None
    for part in parts:
        have = set(part.columns)
        part = part.withColumn("relation_oid", F.lit(oid)).select(
            *[(F.col(f.name) if f.name in have or f.name == "relation_oid" else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHANGES.fields]
        )
        log = part if log is None else log.unionByName(part)
    ing.store_batch(cut_lineage(log), 0, root, MESSAGES_PER_SEGMENT)
    return jobs.restore_table(spark, root, oid).rows


@query("stream_restart", with_fixtures("messages", body=_STORED))
def stream_restart(spark: SparkSession, sf: str) -> DataFrame:
    """Ingest stops half way, is started again, and gets the second quarter once more."""
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    log = cut_lineage(t.messages(t.chg(spark, sf)))
    top = log.agg(F.max("pos")).first()[0] + 1

    def run() -> None:
        ing.ingest(spark, landing, root, f"{root}/checkpoint", max_files=1).awaitTermination()

    begins = log.where("msg_type = 'begin'").groupBy("relation_oid")
    # A redelivery starts with a begin in every relation.
    start = begins.agg(F.max(F.when(F.col("pos") <= top // 4, F.col("pos"))).alias("__start"))
    land(spark, log.where(F.col("pos") < top // 2), landing, 2)
    run()
    again = log.join(start, "relation_oid").where(f"pos >= __start and pos < {top // 2}").drop("__start")
    again.coalesce(1).write.mode("append").parquet(landing)
    run()
    land(spark, log.where(F.col("pos") >= top // 2), landing, 2)
    run()
    return _stored(spark, root)


@query(
    "stream_late_drop",
    with_fixtures(
        "messages",
        "base",
        body="""SELECT m.relation_oid, m.pos, m.msg_type, m.xid, m.final_lsn, m.commit_us FROM messages m JOIN base b ON b.relation_oid = m.relation_oid
WHERE m.final_lsn >= b.start_lsn""",
    ),
)
def stream_late_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of transactions before a table's base are dropped while they stream in."""
    log = t.chg(spark, sf)
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    land(spark, t.messages(log), landing)
    t.base(log).select(
        "relation_oid", "start_lsn", F.current_timestamp().alias("created_at"), F.lit("").alias("path")
    ).write.parquet(f"{root}/snapshots")
    ing.ingest(spark, landing, root, f"{root}/checkpoint", max_files=2).awaitTermination()
    return _stored(spark, root)


@query(
    "stream_replay",
    with_fixtures("done_image", body=_BY_OID.format(image="done_image")),
)
def stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A maintained image: each batch rewrites the key buckets of the tables that it changed."""
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    land(spark, t.messages(t.chg(spark, sf)), landing)
    ing.ingest(spark, landing, root, f"{root}/checkpoint", max_files=2, after_store=image.keep(root, 8)).awaitTermination()
    return _union(
        image.read_image(spark, root, r["relation_oid"]).withColumn("relation_oid", F.lit(r["relation_oid"])) for r in _tables(spark, root)
    )


def _event_stream(spark: SparkSession, sf: str, chosen: str = "true") -> tuple[DataFrame, str]:
    """The stitched change rows of the log, or some of them, as a stream of files."""
    work = scratch_dir(spark, "stream")
    log = t.chg(spark, sf).where(chosen).select(
        "relation_oid",
        F.col("lsn").alias("pos"),
        F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete").alias("msg_type"),
        "final_lsn",
        F.col("ts").cast("timestamp").alias("commit_ts"),
    )
    land(spark, log, f"{work}/in", 3)
    schema = spark.read.parquet(f"{work}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/in"), work


_SESSIONS = """(SELECT relation_oid, sess, epoch_us(min(ts)) AS min_us, epoch_us(max(ts)) + {gap} AS closed_us, count(*) AS messages, min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn
FROM (SELECT *, sum(brk) OVER (PARTITION BY relation_oid ORDER BY ts, lsn ROWS UNBOUNDED PRECEDING) AS sess
      FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap} THEN 1 ELSE 0 END AS brk
            FROM chg WINDOW w AS (PARTITION BY relation_oid ORDER BY ts, lsn)) g) h GROUP BY relation_oid, sess)"""
# The final watermark in whole milliseconds decides which sessions are closed.
_CLOSED = "closed_us <= ((SELECT epoch_us(max(ts)) FROM chg) // 1000 * 1000)"


@query(
    "stream_sessions",
    with_fixtures(
        "chg",
        body=f"SELECT relation_oid, min_us, closed_us, messages, min_lsn, max_lsn FROM {_SESSIONS.format(gap=3600000000)} s WHERE {_CLOSED}",
    ),
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    stream, work = _event_stream(spark, sf)
    closed = live.stream_segments(stream, "1 hour", "0 seconds")
    live.write_append(closed, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    return out.select(
        "relation_oid",
        as_micros(F.col("min_ts")).alias("min_us"),
        as_micros(F.col("closed_at")).alias("closed_us"),
        "messages",
        "min_lsn",
        "max_lsn",
    )


_HELD = "(relation_oid % 2 = 0 OR epoch_us(ts) <= (SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) * 2 // 3 FROM chg))"


@query(
    "stream_sessions_held_back",
    with_fixtures(
        "chg",
        body=f"""SELECT relation_oid, min_us, closed_us, messages, min_lsn, max_lsn FROM {_SESSIONS.format(gap=3600000000).replace("FROM chg WINDOW", f"FROM chg WHERE {_HELD} WINDOW")} s
WHERE closed_us <= (SELECT min(us) FROM (SELECT epoch_us(max(ts)) // 1000 * 1000 AS us FROM chg WHERE {_HELD} GROUP BY relation_oid % 2) m)""",
    ),
)
def stream_sessions_held_back(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams, of which one has not sent its last third: nothing closes that it may still touch."""
    span = t.chg(spark, sf).agg(*[as_micros(f("ts")).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
    cut = span["low"] + (span["high"] - span["low"]) * 2 // 3
    whole, work = _event_stream(spark, sf, "relation_oid % 2 = 0")
    held, _ = _event_stream(spark, sf, f"relation_oid % 2 = 1 and unix_micros(cast(ts as timestamp)) <= {cut}")
    closed = live.stream_segments(live.merged_streams([whole, held], "0 seconds"), "1 hour", None)
    live.write_append(closed, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    return out.select(
        "relation_oid", as_micros(F.col("min_ts")).alias("min_us"), as_micros(F.col("closed_at")).alias("closed_us"), "messages", "min_lsn", "max_lsn"
    )


@query(
    "stream_idle",
    with_fixtures(
        "chg",
        body=f"SELECT relation_oid, closed_us AS idle_us, messages, max_lsn FROM {_SESSIONS.format(gap=7200000000)} s WHERE {_CLOSED}",
    ),
)
def stream_idle(spark: SparkSession, sf: str) -> DataFrame:
    stream, work = _event_stream(spark, sf)
    idle = live.stream_idle_tables(stream, "2 hours", "0 seconds")
    live.write_append(idle, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{work}/out")
    return out.select("relation_oid", as_micros(F.col("idle_since")).alias("idle_us"), "messages", "max_lsn")


@query(
    "stream_idle_clock",
    with_fixtures("chg", body="SELECT relation_oid, count(*) AS messages, max(final_lsn) AS max_lsn FROM chg GROUP BY relation_oid"),
)
def stream_idle_clock(spark: SparkSession, sf: str) -> DataFrame:
    """The log arrives and nothing follows; every table is told idle by the clock."""
    work = scratch_dir(spark, "stream")
    log = cut_lineage(t.chg(spark, sf).select("relation_oid", "final_lsn"))
    tables = log.select("relation_oid").distinct().count()
    log.write.parquet(f"{work}/in")
    idle = live.stream_idle_by_clock(spark.readStream.schema(log.schema).parquet(f"{work}/in"), 2000)
    running = (
        idle.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint")
        .outputMode("append").trigger(processingTime="1 second").start()
    )
    try:
        told, until = 0, time.monotonic() + 300
        while told < tables and time.monotonic() < until and running.isActive:
            time.sleep(0.5)
            if any(p.numInputRows for p in running.recentProgress):
                told = spark.read.schema(idle.schema).parquet(f"{work}/out").count()
    finally:
        running.stop()
    if told < tables:
        raise TimeoutError(f"{told} of {tables} tables were told idle")
    return spark.read.schema(idle.schema).parquet(f"{work}/out")


@query("stream_flush_lsn", with_fixtures("chg", body="SELECT max(final_lsn) - 1 AS flush_lsn FROM chg"))
def stream_flush_lsn(spark: SparkSession, sf: str) -> DataFrame:
    """The last transaction is still open when the ingest stops."""
    landing, root = scratch_dir(spark, "landing"), scratch_dir(spark, "archive")
    land(spark, t.messages(t.chg(spark, sf)), landing, 2)
    ing.ingest(spark, landing, root, f"{root}/checkpoint").awaitTermination()
    return live.stream_flush_lsn(spark, root)


@query(
    "stream_metrics",
    with_fixtures(
        "chg",
        body="""SELECT relation_oid, CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END AS msg_type, count(*) AS messages, 0 AS bytes, epoch_us(max(ts)) AS last_us
FROM chg GROUP BY relation_oid, op""",
    ),
)
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    stream, work = _event_stream(spark, sf)
    live.write_updates(live.stream_metrics(stream), f"{work}/out", f"{work}/checkpoint").awaitTermination()
    out = live.latest_updates(spark, f"{work}/out", ["relation_oid", "msg_type"])
    return out.withColumn("last_us", as_micros(F.col("last_message_ts"))).drop("last_message_ts")


@query("stream_inspect", with_fixtures("messages", body=INSPECT_SQL))
def stream_inspect(spark: SparkSession, sf: str) -> DataFrame:
    work = scratch_dir(spark, "stream")
    land(spark, t.messages(t.chg(spark, sf)), f"{work}/in", 3)
    lines = live.stream_inspect(ing.stream_changes(spark, f"{work}/in"))
    live.write_append(lines, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{work}/out")
