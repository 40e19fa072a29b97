"""Per-table state, metrics, flush positions and the plan of new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.scan import RunningMax, ordered_scan

MIN_SPACING_SECONDS = 3


def table_state(changes: DataFrame, segments: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Counters since the base per relation; everything is derived, nothing is stored.

    ``changes``: relation_oid, final_lsn, commit_ts. ``segments``: relation_oid, max_lsn.
    ``snapshots``: relation_oid, start_lsn, one row per relation.
    """
    bases = snapshots.select("relation_oid", F.col("start_lsn").alias("base_lsn"))
    # Fold to one row per (relation, transaction) first: the base then joins few rows.
    per_tx = changes.groupBy("relation_oid", "final_lsn").agg(
        F.count("*").alias("n"), F.max("commit_ts").alias("ts")
    )
    since = F.col("base_lsn").isNull() | (F.col("final_lsn") > F.col("base_lsn"))
    messages = (
        per_tx.join(bases, "relation_oid", "left")
        .groupBy("relation_oid")
        .agg(
            F.coalesce(F.sum(F.when(since, F.col("n"))), F.lit(0)).cast("bigint").alias("messages_since_base"),
            F.max("ts").alias("last_message_ts"),
            F.max("final_lsn").alias("final_lsn"),
        )
    )
    later = F.col("base_lsn").isNull() | (F.col("max_lsn") > F.col("base_lsn"))
    deltas = (
        segments.join(bases, "relation_oid", "left")
        .groupBy("relation_oid")
        .agg(F.count_if(later).alias("deltas_since_base"), F.max("max_lsn").alias("__flushed"))
    )
    joined = messages.join(deltas, "relation_oid", "full").join(bases, "relation_oid", "full")
    return joined.select(
        "relation_oid",
        F.coalesce("messages_since_base", F.lit(0)).cast("bigint").alias("messages_since_base"),
        F.coalesce("deltas_since_base", F.lit(0)).cast("bigint").alias("deltas_since_base"),
        "last_message_ts",
        "final_lsn",
        F.coalesce(F.greatest("__flushed", "base_lsn"), F.lit(0)).alias("flush_lsn"),
        "base_lsn",
    )


def global_flush_lsn(state: DataFrame, strict: bool = True) -> DataFrame:
    """Position up to which everything of every table is stored.

    ``strict``: just before the first buffered change of any table, or the newest position
    where nothing is buffered (needs ``first_buffered_lsn``, null for none, and
    ``final_lsn``). Otherwise the smallest valid ``flush_lsn``.
    """
    if not strict:
        return state.agg(F.min(F.when(F.col("flush_lsn") != 0, F.col("flush_lsn"))).alias("flush_lsn"))
    return state.agg(
        F.coalesce(F.min(F.col("first_buffered_lsn") - 1), F.max("final_lsn")).alias("flush_lsn")
    )


def flush_progress(history: DataFrame, at: str = "at", lsn: str = "flush_lsn", **scan) -> DataFrame:
    """Acknowledged position over time: candidates that lie behind are ignored."""
    candidates = history.groupBy(at).agg(F.max(lsn).alias("candidate_lsn"))
    return ordered_scan(candidates, [], [at], [RunningMax("flush_lsn", F.col("candidate_lsn"))], **{"levels": 2, **scan})


def _rollup_base(changes: DataFrame) -> DataFrame:
    """Counts per relation and message type: the one pass over the log all metrics share."""
    size = F.col("bytes") if "bytes" in changes.columns else F.lit(0)
    return changes.groupBy("relation_oid", "msg_type").agg(
        F.count("*").alias("messages"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max("commit_ts").alias("last_ts")
    )


def message_rollup(changes: DataFrame) -> DataFrame:
    """Messages and bytes in total, by type, by relation and by both, in one pass.

    The grouping sets expand the few pre-aggregated rows, not the log. ``level`` tells the
    sets apart: ``total``, ``type``, ``relation``, ``relation_type``."""
    level = (
        F.when(F.grouping_id() == 3, "total")
        .when(F.grouping_id() == 2, "type")
        .when(F.grouping_id() == 1, "relation")
        .otherwise("relation_type")
    )
    sets = [[], [F.col("msg_type")], [F.col("relation_oid")], [F.col("relation_oid"), F.col("msg_type")]]
    return (
        _rollup_base(changes)
        .groupingSets(sets, F.col("relation_oid"), F.col("msg_type"))
        .agg(
            F.sum("messages").cast("bigint").alias("messages"),
            F.sum("bytes").cast("bigint").alias("bytes"),
            F.max("last_ts").alias("last_message_ts"),
            level.alias("level"),
        )
    )


def metrics_by_type(changes: DataFrame) -> DataFrame:
    return changes.groupBy("msg_type").agg(F.count("*").alias("messages"))


def metrics_per_table(
    changes: DataFrame, segments: DataFrame, snapshots: DataFrame, dml: tuple[str, ...] = ("insert", "update", "delete", "truncate")
) -> DataFrame:
    """Messages, bytes, last commit, messages since base, segments and last base per table.

    ``segments`` may carry ``idle_closed``. Snapshots: one row per relation."""
    state = table_state(changes, segments, snapshots)
    counted = changes.where(F.col("msg_type").isin(*dml)).groupBy("relation_oid").agg(
        F.count("*").alias("messages"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )
    idle = F.count_if("idle_closed") if "idle_closed" in segments.columns else F.lit(0).cast("bigint")
    files = segments.groupBy("relation_oid").agg(F.count("*").alias("segments"), idle.alias("idle_segments"))
    last_base = snapshots.select("relation_oid", *[c for c in ("created_at",) if c in snapshots.columns])
    return (
        state.select("relation_oid", "messages_since_base", "last_message_ts", "base_lsn")
        .join(counted, "relation_oid", "left")
        .join(files, "relation_oid", "left")
        .join(last_base, "relation_oid", "left")
    )


def metrics_totals(changes: DataFrame, segments: DataFrame) -> DataFrame:
    """Totals: messages, bytes, transactions, last commit, last written, segments.

    Transactions are counted from the commits, once however many tables they touched."""
    is_commit = F.col("msg_type") == "commit"
    per_tx = changes.groupBy("final_lsn").agg(
        F.count("*").alias("n"),
        F.sum("bytes").alias("size"),
        F.max("commit_ts").alias("ts"),
        F.max(F.when(is_commit, F.col("commit_ts"))).alias("committed_ts"),
        F.bool_or(is_commit).alias("committed"),
    )
    log = per_tx.agg(
        F.sum("n").cast("bigint").alias("messages"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if("committed").alias("transactions"),
        F.max("committed_ts").alias("last_commit_ts"),
        F.max("ts").alias("last_written_ts"),
    )
    files = segments.agg(F.count("*").alias("segments"))
    names = [*log.columns, "segments"]
    return log.unionByName(files, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def compaction_plan(
    state: DataFrame,
    threshold: int,
    idle_seconds: int,
    now: Column,
    limit: int | None = None,
    min_spacing_seconds: int = MIN_SPACING_SECONDS,
) -> DataFrame:
    """Tables that need a new snapshot, why, and how overdue they are.

    ``state``: table_state plus ``last_base_ts`` (null where there is no base). ``no_base``
    always counts. Otherwise a table needs changes since its base, and a base that is not
    moments old; then it is due at ``threshold`` segments or after ``idle_seconds`` without
    a change. ``limit`` takes the most overdue tables of one run.
    """
    now_s = F.unix_micros(now) / 1_000_000
    age = now_s - F.unix_micros(F.col("last_base_ts")) / 1_000_000
    quiet = now_s - F.unix_micros(F.col("last_message_ts")) / 1_000_000
    reason = (
        F.when(F.col("base_lsn").isNull(), "no_base")
        .when((F.col("messages_since_base") == 0) | (age <= min_spacing_seconds), None)
        .when(F.col("deltas_since_base") >= threshold, "threshold")
        .when(quiet > idle_seconds, "idle")
    )
    rank = F.when(F.col("reason") == "no_base", 2).when(F.col("reason") == "threshold", 1).otherwise(0)
    plan = state.withColumn("reason", reason).where("reason is not null").withColumn("priority", rank)
    order = [F.desc("priority"), F.desc("deltas_since_base"), F.desc("messages_since_base"), F.asc("relation_oid")]
    plan = plan.orderBy(*order)
    return plan.limit(limit) if limit is not None else plan
