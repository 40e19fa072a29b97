"""Streaming operators over a live change log: sessions, idle tables, counters, tail, image."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from tidelog.operators import state
from tidelog.operators.render import inspect as inspect_lines
from tidelog.plans import jobs
from tidelog.streaming import ingest as ing


def merged_streams(streams: Sequence[DataFrame], delay: str, ts: str = "commit_ts") -> DataFrame:
    """Several change streams as one whose watermark is that of the stream furthest behind.

    What one stream has not sent yet is never late, and nothing closes before it."""
    streams[0].sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return reduce(DataFrame.unionByName, [s.withWatermark(ts, delay) for s in streams])


def stream_segments(changes: DataFrame, gap: str, delay: str | None, ts: str = "commit_ts", lsn: str = "final_lsn") -> DataFrame:
    """Segments that close after an idle gap. A session is emitted once the watermark has
    passed its end, so the last one of a table waits for later changes of any table; sessions of a
    partition are merged before the shuffle. ``delay=None``: the stream has its watermark already."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        (changes if delay is None else changes.withWatermark(ts, delay))
        .groupBy("relation_oid", F.session_window(ts, gap).alias("session"))
        .agg(F.count("*").alias("messages"), F.min(lsn).alias("min_lsn"), F.max(lsn).alias("max_lsn"))
        .select("relation_oid", F.col("session.start").alias("min_ts"), F.col("session.end").alias("closed_at"), "messages", "min_lsn", "max_lsn")
    )


def stream_idle_tables(changes: DataFrame, idle: str, delay: str, ts: str = "commit_ts") -> DataFrame:
    """One row each time a table has changed and then been quiet for ``idle``: the moment a
    new snapshot is due. A quiet table is a session whose gap is the idle time."""
    closed = stream_segments(changes, idle, delay, ts)
    return closed.select("relation_oid", F.col("closed_at").alias("idle_since"), "messages", "max_lsn")


def stream_idle_by_clock(changes: DataFrame, idle_ms: int, lsn: str = "final_lsn") -> DataFrame:
    """One row each time a table has changed and then sent nothing for ``idle_ms`` of wall clock.

    Event time stands still when a whole database goes quiet; a processing-time timer per
    table fires all the same. State is one count and one position per table. Needs a
    processing-time trigger, so that batches run without new data. Rows are counted where they
    are read: a table sends its worker one row per input batch of a task, however hot it is."""
    kind = dict(changes.dtypes)["relation_oid"]

    def counted(batches):
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by("relation_oid").aggregate([([], "count_all"), ("max_lsn", "max")])
            yield from sums.select(["relation_oid", "count_all", "max_lsn_max"]).rename_columns(["relation_oid", "messages", "max_lsn"]).to_batches()

    def run(key, chunks, held):
        if held.hasTimedOut:
            messages, max_lsn = held.get
            held.remove()
            yield pd.DataFrame({"relation_oid": [key[0]], "messages": [messages], "max_lsn": [max_lsn]})
            return
        messages, max_lsn = held.get if held.exists else (0, 0)
        for chunk in chunks:
            messages += int(chunk["messages"].sum())
            newest = chunk["max_lsn"].max()
            if pd.notna(newest):
                max_lsn = max(max_lsn, int(newest))
        held.update((messages, max_lsn))
        held.setTimeoutDuration(idle_ms)

    return (
        changes.select("relation_oid", F.col(lsn).cast("bigint").alias("max_lsn"))
        .mapInArrow(counted, f"relation_oid {kind}, messages bigint, max_lsn bigint")
        .groupBy("relation_oid")
        .applyInPandasWithState(
            run, f"relation_oid {kind}, messages bigint, max_lsn bigint", "messages bigint, max_lsn bigint",
            "append", GroupStateTimeout.ProcessingTimeTimeout,
        )
    )


def stream_flush_lsn(spark: SparkSession, root: str, before_batch: int | None = None) -> DataFrame:
    """Position up to which an ingest has stored every transaction of every table: just before
    the first one that is still open, else the newest commit. One row, null before any commit."""
    known = ing.read_state(spark, root, before_batch)
    return state.global_flush_lsn(
        known.select(F.col("open_lsn").alias("first_buffered_lsn"), F.col("committed_lsn").alias("final_lsn"))
    )


def stream_metrics(changes: DataFrame) -> DataFrame:
    """Running messages and bytes by relation and type, and the newest commit seen. State is
    one row per relation and type."""
    size = F.octet_length("raw") if "raw" in changes.columns else F.lit(0)
    return changes.groupBy("relation_oid", "msg_type").agg(
        F.count("*").alias("messages"),
        F.sum(F.coalesce(size, F.lit(0))).cast("bigint").alias("bytes"),
        F.max("commit_ts").alias("last_message_ts"),
    )


def stream_inspect(changes: DataFrame) -> DataFrame:
    """Lines of the live tail."""
    return inspect_lines(changes).select("relation_oid", "pos", "line")


def write_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results to Parquet, exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows each batch changed under its batch id (see ``latest_updates``)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current value per key of a result written with ``write_updates``."""
    updates = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__u"))
    return newest.select(*keys, *[F.col(f"__u.{c}").alias(c) for c in rest])


def compact_every(root: str, batches: int, oids: list[int]):
    """Hook for ``ingest``: a new snapshot of the given tables every so many batches, so that
    the maintained image is a snapshot plus a short tail and no streaming state grows."""

    def after_store(spark: SparkSession, batch_id: int) -> None:
        if (batch_id + 1) % batches == 0:
            for oid in oids:
                try:
                    jobs.compact(spark, root, oid)
                except LookupError:
                    continue  # nothing committed for this table yet

    return after_store
