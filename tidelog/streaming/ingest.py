"""Continuous ingest of a landing directory into the archive.

A micro-batch is decoded, stitched, numbered, cleaned of redelivered and superseded
messages, cut into segments and written under its batch id. What one batch must tell the
next is one row per relation: how far it is committed, which transaction is still open, and
where the next message and segment are counted from. That row is published in one commit with
the batch, so that a repeated batch starts from the same state and takes the place of its own
output. Files arrive in log order; a redelivery starts with a ``begin``. A batch that shows a
hole in the log fails before anything of it is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import segments as seg
from tidelog.operators import transactions
from tidelog.operators.lookup import join_small, with_value
from tidelog.operators.scan import Last, Prev, RowNumber, ordered_scan
from tidelog.schema import CHANGES, DML_TYPES
from tidelog.session import cut_lineage
from tidelog.sources import commits, datasource, store
from tidelog.sources.files import named_paths
from tidelog.sources.segments import named_segments, read_frames, with_stream_position
from tidelog.sources.wire import decode_messages
from tidelog.streaming import landing as taken

MAX_FILES = 1000
_CARRY_POS = -1
GAP = "__gap"
LOG_STREAM = 0  # no table has this id

STATE = T.StructType(
    [
        T.StructField("relation_oid", T.LongType()),
        T.StructField("committed_lsn", T.LongType()),
        T.StructField("open_xid", T.IntegerType()),
        T.StructField("open_lsn", T.LongType()),
        T.StructField("open_ts", T.TimestampType()),
        T.StructField("open_seq", T.IntegerType()),
        # Bytes of the relation's stream that were read, and segments that were cut.
        T.StructField("next_pos", T.LongType()),
        T.StructField("next_segment", T.LongType()),
    ]
)
_BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def stream_changes(spark: SparkSession, landing: str, binary: bool = False, max_files: int | None = None) -> DataFrame:
    """Stream of landed files: decoded changes as Parquet, or binary segments by path and length.
    The contents of segments are read by the tasks that decode them (see ``decode_batch``).

    The names of all files pass through the driver; ``ingest`` takes binary ones this way only with
    ``max_files``. Files are taken by their times, ``max_files`` at once: by default ``MAX_FILES`` of Parquet,
    but all binary ones that are there. Many tasks write those, so their times do not follow the log,
    and a cut by times would part a relation's files; inside a batch their names give the order."""
    if max_files is None and not binary:
        max_files = MAX_FILES
    reader = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    if binary:
        files = reader.format("binaryFile").schema(_BINARY_FILE).option("recursiveFileLookup", "true").load(landing)
        return files.select("path", "length")
    return reader.schema(CHANGES).parquet(landing)


def decode_batch(files: DataFrame, state: DataFrame, mode: str = "FAILFAST") -> tuple[DataFrame, DataFrame]:
    """Binary files (path, length) of one batch to changes, and (relation_oid, next_pos) after them.

    ``pos`` counts the bytes of the relation's stream before the message, from where the batch
    before ended: files in order of (first position, postfix), frames in order inside a file."""
    placed = cut_lineage(with_stream_position(named_segments(files)))
    ended = placed.groupBy("relation_oid").agg(F.max(F.col("start") + F.col("length")).alias("bytes"))
    known = state.select("relation_oid", F.coalesce("next_pos", F.lit(0).cast("bigint")).alias("from"))
    # One row per file and relation; both are metadata.
    based = placed.join(known, "relation_oid", "left").withColumn("start", F.col("start") + F.coalesce("from", F.lit(0)))
    frames = read_frames(based.select("relation_oid", "path", "length", "start"), mode)
    changes = decode_messages(frames.select("relation_oid", (F.col("start") + F.col("byte")).alias("pos"), "raw"), mode)
    after = ended.join(known, "relation_oid", "left").select(
        "relation_oid", (F.col("bytes") + F.coalesce("from", F.lit(0))).alias("next_pos")
    )
    return changes, after


def route_log(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Messages of the whole log as one stream per relation.

    In the log itself ``begin`` and ``commit`` belong to no relation. Each transaction's
    header is carried along the log and its control messages are written to exactly the
    relations it touched, in this batch or, for the transaction still open, in an earlier
    one. The control messages also stay as a stream of their own, relation ``LOG_STREAM``.
    """
    carried = state.where(f"relation_oid = {LOG_STREAM} and open_lsn is not null").select(
        F.lit(_CARRY_POS).cast("bigint").alias("pos"),
        F.lit("begin").alias("msg_type"),
        F.col("open_xid").alias("xid"),
        F.col("open_lsn").alias("final_lsn"),
        F.col("open_ts").alias("commit_ts"),
    )
    header = F.when(F.col("msg_type") == "begin", F.struct("xid", "final_lsn", "commit_ts", F.col("pos").alias("tx_pos")))
    # What is read several times below is written once: a plan of it all grows with every use.
    scanned = ordered_scan(
        batch.unionByName(carried, allowMissingColumns=True), [], ["pos"], [Last("__h", header)], materialise=True
    )
    own_ts = F.when(F.col("msg_type") == "commit", F.col("commit_ts")).otherwise(F.col("__h.commit_ts"))
    headed = scanned.where(F.col("pos") != _CARRY_POS).select(
        *[c for c in batch.columns if c not in ("xid", "final_lsn", "commit_ts")],
        F.col("__h.xid").alias("xid"),
        F.col("__h.final_lsn").alias("final_lsn"),
        own_ts.alias("commit_ts"),
        F.col("__h.tx_pos").alias("tx_pos"),
    )
    headed = cut_lineage(headed)
    is_control = F.col("msg_type").isin("begin", "commit")
    control = headed.where(is_control)
    spread = transactions.explode_truncate(headed)
    rows = headed.where(~is_control & (F.col("msg_type") != "truncate")).unionByName(spread)
    rows = rows.where("relation_oid is not null").withColumn("pos", F.col("pos") * 4 + 1)

    touched = rows.where("tx_pos is not null").groupBy("relation_oid", "final_lsn", "tx_pos").agg(
        F.min("pos").alias("first"), F.max("xid").alias("xid")
    )
    touched = cut_lineage(touched)
    still_open = state.where(f"relation_oid <> {LOG_STREAM} and open_lsn is not null").select(
        "relation_oid", F.col("open_lsn").alias("final_lsn"), F.lit(_CARRY_POS).cast("bigint").alias("tx_pos")
    )
    tx = ["relation_oid", "final_lsn", "tx_pos"]
    times = control.where("msg_type = 'begin'").select("tx_pos", F.col("commit_ts").alias("ts")).unionByName(
        carried.select(F.col("pos").alias("tx_pos"), F.col("commit_ts").alias("ts"))
    )
    begins = touched.join(still_open, tx, "left_anti").join(times, "tx_pos", "left").select(
        "relation_oid", (F.col("first") - 1).alias("pos"), F.lit("begin").alias("msg_type"), "xid", "final_lsn", F.col("ts").alias("commit_ts")
    )
    concerned = touched.select(*tx).unionByName(still_open).distinct()
    ends = control.where("msg_type = 'commit'").drop("relation_oid").withColumn("pos", F.col("pos") * 4 + 2)
    commits = ends.join(concerned, ["final_lsn", "tx_pos"])
    stream = control.withColumn("relation_oid", F.lit(LOG_STREAM).cast("bigint")).withColumn("pos", F.col("pos") * 4 + 1)
    parts = [stream, commits.select(stream.columns), begins]
    out = rows
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.drop("tx_pos")


def advance(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Stitched, numbered and new messages of a batch, given the state before it.

    A message is new if its transaction is beyond the committed position and, for the
    transaction that was open, if its number is beyond what is stored already. ``GAP`` marks
    messages that cannot follow what came before them.
    """
    carried = state.where("open_lsn is not null").select(
        "relation_oid",
        F.lit(_CARRY_POS).cast("bigint").alias("pos"),
        F.lit("begin").alias("msg_type"),
        F.col("open_xid").alias("xid"),
        F.col("open_lsn").alias("final_lsn"),
        F.col("open_ts").alias("commit_ts"),
        F.col("open_seq").alias("__stored"),
    )
    with_carry = batch.unionByName(carried, allowMissingColumns=True)
    header = F.when(
        F.col("msg_type") == "begin",
        F.struct("xid", "final_lsn", "commit_ts", F.col("pos").alias("tx_pos"), F.coalesce("__stored", F.lit(0)).alias("stored")),
    )
    control = F.when(F.col("msg_type").isin("begin", "commit"), F.struct("msg_type", "final_lsn"))
    stitched = ordered_scan(
        with_carry, ["relation_oid"], ["pos"], [Last("__h", header), Prev("__before", control)], materialise=True
    )
    # Files that are missing or out of order leave traces: a message outside any transaction,
    # a commit of another transaction, or a later begin while one is still open.
    inside = F.col("msg_type").isin(*DML_TYPES, "commit")
    gap = (
        (inside & ~F.col("__before.msg_type").eqNullSafe(F.lit("begin")))
        | ((F.col("msg_type") == "commit") & (F.col("commit_lsn") != F.col("__h.final_lsn")))
        | (
            (F.col("msg_type") == "begin")
            & F.col("__before.msg_type").eqNullSafe(F.lit("begin"))
            & (F.col("final_lsn") > F.col("__before.final_lsn"))
        )
    )
    rest = [c for c in batch.columns if c not in ("xid", "final_lsn", "commit_ts", "tx_pos", "seq")]
    headed = stitched.where(F.col("pos") != _CARRY_POS).select(
        *rest,
        F.col("__h.xid").alias("xid"),
        F.col("__h.final_lsn").alias("final_lsn"),
        F.col("__h.commit_ts").alias("commit_ts"),
        # Messages before any begin share a marker of their own.
        F.coalesce("__h.tx_pos", F.lit(_CARRY_POS - 1)).alias("tx_pos"),
        F.col("__h.stored").alias("__stored"),
        F.coalesce(gap, F.lit(False)).alias(GAP),
    )
    numbered = ordered_scan(headed, ["relation_oid", "tx_pos"], ["pos"], [RowNumber("__n")], materialise=True)
    numbered = numbered.withColumn("seq", (F.col("__n") + F.coalesce("__stored", F.lit(0))).cast("int")).drop(
        "__n", "__stored"
    )
    # Written once: the redeliveries, the stored changes and the next state all come from it.
    numbered = cut_lineage(numbered)
    once = transactions.dedupe(numbered)
    once = once if once is numbered else cut_lineage(once)
    known = state.select("relation_oid", "committed_lsn", "open_lsn", "open_seq")
    joined = join_small(once, known, ["relation_oid"])
    beyond = F.col("committed_lsn").isNull() | (F.col("final_lsn") > F.col("committed_lsn"))
    stored = F.coalesce((F.col("final_lsn") == F.col("open_lsn")) & (F.col("seq") <= F.col("open_seq")), F.lit(False))
    fresh = joined.where(F.col(GAP) | F.col("final_lsn").isNull() | (beyond & ~stored))
    return fresh.drop("committed_lsn", "open_lsn", "open_seq")


def next_state(rows: DataFrame, state: DataFrame, read: DataFrame | None = None, cut: DataFrame | None = None) -> DataFrame:
    """State after the new messages of a batch. One row per relation.

    ``read``: (relation_oid, next_pos) after the files of the batch. ``cut``: (relation_oid, next_segment)."""
    last = F.struct("final_lsn", "seq")
    seen = rows.where("final_lsn is not null").groupBy("relation_oid").agg(
        F.max(F.when(F.col("msg_type") == "commit", F.col("final_lsn"))).alias("committed"),
        F.max_by(F.struct("xid", "final_lsn", "commit_ts", "seq"), last).alias("last"),
    )
    joined = state.withColumnsRenamed({"next_pos": "pos_before", "next_segment": "segment_before"}).join(seen, "relation_oid", "full")
    for part, name in ((read, "next_pos"), (cut, "next_segment")):
        if part is None:
            joined = joined.withColumn(name, F.lit(None).cast("bigint"))
        else:
            joined = joined.join(part.select("relation_oid", name), "relation_oid", "full")
    committed = F.greatest("committed_lsn", "committed")
    before = F.struct(
        F.col("open_xid").alias("xid"),
        F.col("open_lsn").alias("final_lsn"),
        F.col("open_ts").alias("commit_ts"),
        F.col("open_seq").alias("seq"),
    )
    current = F.when(F.col("last").isNotNull(), F.col("last")).otherwise(before)
    is_open = committed.isNull() | (current["final_lsn"] > committed)
    return joined.select(
        "relation_oid",
        committed.alias("committed_lsn"),
        F.when(is_open, current["xid"]).alias("open_xid"),
        F.when(is_open, current["final_lsn"]).alias("open_lsn"),
        F.when(is_open, current["commit_ts"]).alias("open_ts"),
        F.when(is_open, current["seq"]).alias("open_seq"),
        F.coalesce("next_pos", "pos_before").alias("next_pos"),
        F.coalesce("next_segment", "segment_before").alias("next_segment"),
    )


def read_state(spark: SparkSession, root: str, before_batch: int | None = None) -> DataFrame:
    """State the given batch starts from, or the newest one: its path stands in the newest commit."""
    path = commits.ingest_state(spark, root, before_batch)
    return spark.createDataFrame([], STATE) if path is None else spark.read.schema(STATE).parquet(path)


def store_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    messages_per_segment: int = 10_000,
    tables: DataFrame | None = None,
    after_store: Callable[[SparkSession, int], None] | None = None,
    whole_log: bool = False,
    read: DataFrame | None = None,
) -> None:
    """Write one batch of decoded changes; repeating the newest batch replaces what it wrote.

    ``whole_log``: the messages are the log itself, in one order, and control messages
    belong to no relation. Otherwise every relation has a stream of its own. ``read``: how far
    the streams of the relations were read with this batch (see ``decode_batch``)."""
    spark = batch.sparkSession
    state = read_state(spark, root, batch_id)
    if whole_log:
        routed = route_log(batch, state)
    else:
        spread = transactions.explode_truncate(batch)
        routed = batch.where("msg_type <> 'truncate'").unionByName(spread)
    if tables is not None:
        known = tables.select("relation_oid").unionByName(
            spark.range(1).select(F.lit(LOG_STREAM).cast("bigint").alias("relation_oid"))
        )
        routed = transactions.tracked(routed, known)
    # Only messages of a relation have a place in its stream.
    routed = routed.where("relation_oid is not null")
    rows = advance(routed, state)
    broken = rows.where(F.col(GAP)).select("relation_oid", "pos", "msg_type").take(5)
    if broken:
        raise ValueError(f"batch {batch_id} is not in log order or misses files before {[tuple(r) for r in broken]}")
    rows = rows.drop(GAP)
    snapshots = store.read_snapshots(spark, root)
    kept = rows
    if snapshots is not None:
        late = transactions.drop_superseded(rows.where("final_lsn is not null"), store.latest_snapshots(snapshots))
        kept = late.unionByName(rows.where("final_lsn is null"))
    cut = seg.segment_by_count(kept, messages_per_segment)
    cut = with_value(cut, state.select("relation_oid", F.col("next_segment").alias("__from")), "__from")
    cut = cut.withColumn("segment_id", F.coalesce("__from", F.lit(0).cast("bigint")) + F.col("segment_id")).drop("__from")
    # A count of what is kept, since segments are cut every so many messages.
    segments = kept.groupBy("relation_oid").agg(F.ceil(F.count("*") / messages_per_segment).alias("n"))
    ended = segments.join(state.select("relation_oid", "next_segment"), "relation_oid", "left").select(
        "relation_oid", (F.coalesce("next_segment", F.lit(0)) + F.col("n")).alias("next_segment")
    )
    # Superseded messages still move the state on, so it comes from all new messages.
    path = f"{root}/ingest_state/{uuid.uuid4().hex}"
    next_state(rows, state, read, ended).write.parquet(path)
    store.write_segments(cut, root, batch_id, path)
    if after_store is not None:
        after_store(spark, batch_id)


def ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    binary: bool = False,
    max_files: int | None = None,
    messages_per_segment: int = 10_000,
    tables: DataFrame | None = None,
    mode: str = "FAILFAST",
    after_store: Callable[[SparkSession, int], None] | None = None,
    continuous: str | None = None,
    whole_log: bool = False,
    by_name: bool = False,
) -> StreamingQuery:
    """Start the ingest of a landing directory. Processes what is there and stops, or with
    ``continuous`` (a processing interval) keeps running.

    Binary files are taken all that are there at once, in log order, and listed by tasks (see
    ``landing``); ``max_files`` takes so many of them by their times, which then have to follow the log. With ``by_name`` they come from the data
    source, whose offsets follow the names (see ``sources.datasource``)."""

    # A checkpoint that Spark's file source began goes on with it.
    by_tasks = binary and max_files is None and not by_name and not taken.taken_by_file_source(spark, checkpoint)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, changes, read = batch.sparkSession, batch, None
        if by_name:
            changes = cut_lineage(decode_messages(batch.select("relation_oid", "pos", "raw"), mode))
        elif binary:
            files = taken.take(spark, landing, checkpoint, batch_id) if by_tasks else batch
            if files is None:
                return  # nothing has landed since
            changes, read = decode_batch(files, read_state(spark, root, batch_id), mode)
            changes = cut_lineage(changes)  # files are read and decoded once
        store_batch(changes, batch_id, root, messages_per_segment, tables, after_store, whole_log, read)

    if by_name:
        datasource.register(spark)
        stream = spark.readStream.format("tidelog_segments").option("mode", mode).load(landing)
    elif by_tasks:
        named_paths(spark, landing)  # a landing directory that is not there fails at once
        datasource.register(spark)
        stream = spark.readStream.format("tidelog_looks").load()
    else:
        stream = stream_changes(spark, landing, binary, max_files)
    writer = stream.writeStream.foreachBatch(run)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()
