"""Segments: where they close, their header statistics, order, purge and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.lsn import segment_name
from tidelog.operators.scan import Prev, RowNumber, RunningSum, ordered_scan


def _chunk(row_number: Column, size: int) -> Column:
    return F.floor((row_number - 1) / F.lit(size)).cast("bigint")


def segment_by_count(changes: DataFrame, n: int, order: str = "pos", **scan) -> DataFrame:
    """Close a segment every ``n`` messages of a relation, control messages included."""
    numbered = ordered_scan(changes, ["relation_oid"], [order], [RowNumber("__rn")], **scan)
    return numbered.withColumn("segment_id", _chunk(F.col("__rn"), n)).drop("__rn")


def segment_by_gap(
    changes: DataFrame, gap_seconds: int, order: str = "pos", ts: str = "commit_ts", **scan
) -> DataFrame:
    """Close a segment after an idle gap. Adds ``session_id``, from 1 per relation."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    previous = ordered_scan(changes, ["relation_oid"], [order], [Prev("__prev", micros)], **scan)
    opens = F.col("__prev").isNull() | (micros - F.col("__prev") > F.lit(gap_seconds * 1_000_000))
    sessions = ordered_scan(
        previous, ["relation_oid"], [order], [RunningSum("session_id", opens.cast("bigint"))], **scan
    )
    return sessions.drop("__prev")


def segment_combined(
    changes: DataFrame, n: int, gap_seconds: int, order: str = "pos", ts: str = "commit_ts", **scan
) -> DataFrame:
    """Count limit inside idle sessions. Adds ``session_id`` and ``part``."""
    sessions = segment_by_gap(changes, gap_seconds, order, ts, **scan)
    numbered = ordered_scan(sessions, ["relation_oid", "session_id"], [order], [RowNumber("__rn")], **scan)
    return numbered.withColumn("part", _chunk(F.col("__rn"), n)).drop("__rn")


def segment_stats(changes: DataFrame, by: Sequence[str] = ("relation_oid", "segment_id")) -> DataFrame:
    """Segment header: bounds of commit position and time, count, and a content checksum."""
    aggs = [
        F.min("final_lsn").alias("min_lsn"),
        F.max("final_lsn").alias("max_lsn"),
        F.count("*").alias("messages"),
    ]
    if "commit_ts" in changes.columns:
        aggs += [F.min("commit_ts").alias("min_ts"), F.max("commit_ts").alias("max_ts")]
    if "raw" in changes.columns:
        aggs += [
            F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("bigint").alias("bytes"),
            # pmod keeps the sum inside 63 bits for any segment below 2**31 messages
            F.sum(F.pmod(F.xxhash64("raw"), F.lit(4294967296))).cast("bigint").alias("checksum"),
        ]
    return changes.groupBy(*by).agg(*aggs)


def segment_postfix(segments: DataFrame, order: str = "segment_id", **scan) -> DataFrame:
    """Number the segments that share a first position, and name them.

    One huge transaction is cut into many segments with one ``min_lsn``."""
    numbered = ordered_scan(segments, ["relation_oid", "min_lsn"], [order], [RowNumber("__rn")], **scan)
    return (
        numbered.withColumn("postfix", F.col("__rn") - 1)
        .withColumn("segment_name", segment_name(F.col("min_lsn"), F.col("postfix")))
        .drop("__rn")
    )


def ordered_segments(segments: DataFrame) -> DataFrame:
    return segments.orderBy("relation_oid", "min_lsn", "postfix")


def obsolete_segments(segments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Segments a base supersedes: every transaction in them is at or before the base.

    A segment that straddles the base is kept, since its later transactions are needed."""
    bases = snapshots.select("relation_oid", F.col("start_lsn").alias("base_lsn"))
    return segments.join(bases, "relation_oid").where("max_lsn <= base_lsn")


def live_segments(segments: DataFrame, snapshots: DataFrame) -> DataFrame:
    bases = snapshots.select("relation_oid", F.col("start_lsn").alias("__base"))
    joined = segments.join(bases, "relation_oid", "left")
    return joined.where("__base is null or max_lsn is null or max_lsn > __base").drop("__base")


def all_segments(staging: DataFrame, archive: DataFrame, by: Sequence[str] = ("relation_oid", "segment_id")) -> DataFrame:
    """Staging and archive as one set; a segment in both is taken from staging."""
    both = staging.withColumn("location", F.lit("staging")).unionByName(
        archive.withColumn("location", F.lit("archive"))
    )
    rest = [c for c in both.columns if c not in by]
    priority = F.when(F.col("location") == "staging", 0).otherwise(1)
    picked = both.groupBy(*by).agg(F.min_by(F.struct(*rest), priority).alias("__row"))
    return picked.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])


def audit(source: DataFrame, target: DataFrame, by: Sequence[str] = ("relation_oid", "segment_id")) -> DataFrame:
    """Compare two copies of a set of segments: rows and content checksum per segment."""
    content = F.pmod(F.xxhash64(*[c for c in source.columns]), F.lit(4294967296))

    def sums(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*by).agg(
            F.count("*").alias(f"{side}_rows"), F.sum(content).cast("bigint").alias(f"{side}_sum")
        )

    joined = sums(source, "source").join(sums(target, "target"), list(by), "full")
    return joined.withColumn(
        "ok",
        F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_sum").eqNullSafe(F.col("target_sum")),
    )
