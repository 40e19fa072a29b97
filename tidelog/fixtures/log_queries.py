"""Queries over the change log: replay, transactions, segments, state, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import tables as t
from tidelog.fixtures.oracles import at_share, with_fixtures
from tidelog.fixtures.registry import query
from tidelog.functions.lsn import as_micros
from tidelog.operators import catalog, replay, segments, state, transactions, verify

KEYS = ["relation_oid", "k"]
DATA = ["value", "props"]
ORDER = ["lsn"]
SEGMENT_MESSAGES = 50
GAP_SECONDS = 3600


# --- replay ------------------------------------------------------------------------------


@query("replay_keyed", with_fixtures("image", body="SELECT * FROM image"))
def replay_keyed(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_keyed(t.chg(spark, sf), KEYS, DATA, ORDER)


@query(
    "replay_full",
    with_fixtures(
        "chg_full",
        body="""SELECT r.t, r.g FROM (SELECT t, g, CAST(sum(w) AS BIGINT) AS n FROM chg_full GROUP BY t, g HAVING sum(w) > 0) r
JOIN (SELECT unnest(range(0, (SELECT count(*) FROM events))) AS i) s ON s.i < r.n""",
    ),
)
def replay_full(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay_full(t.chg_full(spark, sf), ["t", "g"])


@query("key_move_restore", with_fixtures("moves_expected", body="SELECT * FROM moves_expected"))
def key_move_restore(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(t.moves(spark, sf), ["k"], ["status"], ["pos"], by=[])


@query("replay_truncate", with_fixtures("trunc_expected", body="SELECT * FROM trunc_expected"))
def replay_truncate(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    truncates = t.base(log).select("relation_oid", F.col("start_lsn").alias("lsn"))
    return replay.replay_keyed(replay.after_truncate(log, truncates, ORDER), KEYS, DATA, ORDER)


@query("restore_from_base", with_fixtures("image", body="SELECT * FROM image"))
def restore_from_base(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    bases = t.base(log)
    upto = log.join(bases, "relation_oid").where("final_lsn <= start_lsn")
    rows = replay.replay_keyed(upto, KEYS, DATA, ORDER).join(bases, "relation_oid")
    tail = transactions.after_base(log, bases)
    return replay.replay_keyed(replay.base_plus_tail(rows, tail, KEYS, DATA, ORDER), KEYS, DATA, ORDER)


@query(
    "replay_anomalies",
    with_fixtures(
        "chg",
        "base",
        body="""SELECT relation_oid, k, CASE WHEN op = 'U' THEN 'update_of_missing_row' ELSE 'delete_of_missing_row' END AS anomaly, count(*) AS changes
FROM (SELECT c.*, max(CASE WHEN op = 'I' THEN lsn END) OVER w AS li, max(CASE WHEN op = 'D' THEN lsn END) OVER w AS ld
      FROM chg c JOIN base b ON b.relation_oid = c.relation_oid WHERE c.final_lsn > b.start_lsn
      WINDOW w AS (PARTITION BY c.relation_oid, c.k ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x
WHERE op <> 'I' AND (li IS NULL OR li < coalesce(ld, 0))
GROUP BY relation_oid, k, op""",
    ),
)
def replay_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    return replay.replay_anomalies(transactions.after_base(log, t.base(log)), KEYS, ORDER)


# --- transactions --------------------------------------------------------------------------


def stitched(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.stitch_transactions(t.chg_ctl(t.chg(spark, sf)))


@query("stitch_tx", with_fixtures("stitched", body="SELECT relation_oid, pos, msg_type, k, xid, final_lsn FROM stitched"))
def stitch_tx(spark: SparkSession, sf: str) -> DataFrame:
    return stitched(spark, sf).drop("tx_pos")


@query(
    "tx_seq",
    with_fixtures(
        "stitched",
        body="""SELECT relation_oid, final_lsn, pos, msg_type,
       row_number() OVER (PARTITION BY relation_oid, final_lsn ORDER BY pos) AS seq FROM stitched""",
    ),
)
def tx_seq(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.with_seq(stitched(spark, sf)).select("relation_oid", "final_lsn", "pos", "msg_type", "seq")


@query(
    "committed_only",
    with_fixtures(
        "stitched",
        body="""SELECT relation_oid, pos, msg_type, final_lsn FROM stitched
WHERE (relation_oid, final_lsn) IN (SELECT relation_oid, final_lsn FROM stitched WHERE msg_type = 'commit')""",
    ),
)
def committed_only(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.committed(stitched(spark, sf)).select("relation_oid", "pos", "msg_type", "final_lsn")


@query(
    "dml_only",
    with_fixtures("chg_ctl", body="SELECT relation_oid, pos, msg_type, k FROM chg_ctl WHERE msg_type NOT IN ('begin', 'commit')"),
)
def dml_only(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.dml_only(t.chg_ctl(t.chg(spark, sf))).select("relation_oid", "pos", "msg_type", "k")


@query(
    "tail_after_base",
    with_fixtures(
        "chg",
        "base",
        body="SELECT c.relation_oid, c.lsn, c.op FROM chg c JOIN base b ON b.relation_oid = c.relation_oid WHERE c.final_lsn > b.start_lsn",
    ),
)
def tail_after_base(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    return transactions.after_base(log, t.base(log)).select("relation_oid", "lsn", "op")


@query(
    "ingest_late_drop",
    with_fixtures(
        "chg",
        "base",
        body="SELECT c.relation_oid, c.lsn, c.op FROM chg c JOIN base b ON b.relation_oid = c.relation_oid WHERE c.final_lsn >= b.start_lsn",
    ),
)
def ingest_late_drop(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    return transactions.drop_superseded(log, t.base(log)).select("relation_oid", "lsn", "op")


def _early_tables(log: DataFrame) -> DataFrame:
    """Registered tables: those whose base is early."""
    return t.base(log).where(F.col("start_lsn") <= t.at_share(log, 2))


@query(
    "tracked_semi",
    with_fixtures("chg", "base", body=f"SELECT relation_oid, lsn, op FROM chg WHERE relation_oid IN (SELECT relation_oid FROM base WHERE start_lsn <= {at_share(2)})"),
)
def tracked_semi(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    return transactions.tracked(log, _early_tables(log)).select("relation_oid", "lsn", "op")


@query(
    "orphan_anti",
    with_fixtures("chg", "base", body=f"SELECT relation_oid, lsn, op FROM chg WHERE relation_oid NOT IN (SELECT relation_oid FROM base WHERE start_lsn <= {at_share(2)})"),
)
def orphan_anti(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    return transactions.orphans(log, _early_tables(log)).select("relation_oid", "lsn", "op")


@query("tx_touched", with_fixtures("chg", body="SELECT DISTINCT xid, final_lsn, relation_oid FROM chg"))
def tx_touched(spark: SparkSession, sf: str) -> DataFrame:
    return transactions.touched(t.chg(spark, sf))


@query(
    "tx_control_fanout",
    with_fixtures(
        "chg",
        body="""SELECT t.xid % 97 AS xid, t.relation_oid, m.msg_type, t.final_lsn FROM (SELECT DISTINCT xid, relation_oid, final_lsn FROM chg) t
JOIN (SELECT 'begin' AS msg_type UNION ALL SELECT 'commit') m ON true""",
    ),
)
def tx_control_fanout(spark: SparkSession, sf: str) -> DataFrame:
    # Transaction ids wrap; the end of the transaction tells them apart.
    log = t.chg(spark, sf).withColumn("xid", F.col("xid") % 97)
    kinds = F.explode(F.array(F.lit("begin"), F.lit("commit")))
    control = log.select("xid", "final_lsn").distinct().select("xid", "final_lsn", kinds.alias("msg_type"))
    fanned = transactions.fan_out_control(control, transactions.touched(log))
    return fanned.select("xid", "relation_oid", "msg_type", "final_lsn")


@query(
    "tx_summary",
    with_fixtures(
        "chg",
        body="""SELECT xid, final_lsn, count(*) AS messages, count(DISTINCT relation_oid) AS tables,
       CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes, epoch_us(max(ts)) AS commit_us FROM chg GROUP BY xid, final_lsn""",
    ),
)
def tx_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf).withColumn("bytes", F.coalesce(F.octet_length("props"), F.lit(0)))
    out = transactions.tx_summary(log.withColumnRenamed("ts", "commit_ts"))
    return out.withColumn("commit_us", as_micros(F.col("commit_ts"))).drop("commit_ts")


@query("dedupe_redelivery", with_fixtures("chg", body="SELECT relation_oid, final_lsn, lsn AS seq, op, k FROM chg"))
def dedupe_redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """The whole log delivered twice, the second time at later positions."""
    log = t.chg(spark, sf).select("relation_oid", "final_lsn", F.col("lsn").alias("seq"), F.col("lsn").alias("pos"), "op", "k")
    log = log.withColumn("tx_pos", F.col("final_lsn") - 8)
    again = log.withColumns({c: F.col(c) + 1_000_000_000 for c in ("pos", "tx_pos")})
    return transactions.dedupe(log.unionByName(again)).drop("pos", "tx_pos")


@query(
    "change_order",
    with_fixtures("stitched", body="SELECT relation_oid, final_lsn, pos, msg_type FROM stitched"),
)
def change_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = transactions.ordered_changes(stitched(spark, sf))
    return ordered.select("relation_oid", "final_lsn", "pos", "msg_type")


# --- segments ------------------------------------------------------------------------------


@query(
    "segment_by_count",
    with_fixtures(
        "chg_ctl",
        body=f"""SELECT relation_oid, pos, CAST(floor((row_number() OVER (PARTITION BY relation_oid ORDER BY pos) - 1) / {SEGMENT_MESSAGES}) AS BIGINT) AS segment_id
FROM chg_ctl""",
    ),
)
def segment_by_count(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.segment_by_count(t.chg_ctl(t.chg(spark, sf)), SEGMENT_MESSAGES)
    return out.select("relation_oid", "pos", "segment_id")


@query(
    "segment_by_gap",
    with_fixtures(
        "chg",
        body="""SELECT relation_oid, lsn, CAST(sum(brk) OVER (PARTITION BY relation_oid ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id
FROM (SELECT relation_oid, lsn, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS brk
      FROM chg WINDOW w AS (PARTITION BY relation_oid ORDER BY lsn)) g""",
    ),
)
def segment_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.segment_by_gap(t.chg(spark, sf), GAP_SECONDS, "lsn", "ts")
    return out.select("relation_oid", "lsn", "session_id")


def segs(log: DataFrame) -> DataFrame:
    cut = segments.segment_combined(log.withColumnRenamed("ts", "commit_ts"), SEGMENT_MESSAGES, GAP_SECONDS, "lsn")
    return segments.segment_stats(cut, ("relation_oid", "session_id", "part"))


@query(
    "segment_combined",
    with_fixtures(
        "segs",
        body="SELECT relation_oid, sess AS session_id, part, min_lsn, max_lsn, n AS messages, epoch_us(min_ts) AS min_us, epoch_us(max_ts) AS max_us FROM segs",
    ),
)
def segment_combined(spark: SparkSession, sf: str) -> DataFrame:
    out = segs(t.chg(spark, sf))
    return out.select(
        "relation_oid",
        "session_id",
        "part",
        "min_lsn",
        "max_lsn",
        "messages",
        as_micros(F.col("min_ts")).alias("min_us"),
        as_micros(F.col("max_ts")).alias("max_us"),
    )


_COUNTED = f"""(SELECT *, CAST(floor((row_number() OVER (PARTITION BY relation_oid ORDER BY pos) - 1) / {SEGMENT_MESSAGES}) AS BIGINT) AS segment_id FROM stitched)"""
_MANIFEST = f"""(SELECT relation_oid, segment_id, min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn, count(*) AS messages
FROM {_COUNTED} GROUP BY relation_oid, segment_id)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment_stats(segments.segment_by_count(stitched(spark, sf), SEGMENT_MESSAGES))


@query("segment_manifest", with_fixtures("stitched", body=f"SELECT * FROM {_MANIFEST}"))
def segment_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf)


_NAMED = f"""(SELECT relation_oid, min_lsn, segment_id, postfix,
  lower(lpad(printf('%x', min_lsn), 16, '0')) || CASE WHEN postfix = 0 THEN '' ELSE '.' || postfix END AS segment_name
FROM (SELECT *, row_number() OVER (PARTITION BY relation_oid, min_lsn ORDER BY segment_id) - 1 AS postfix FROM {{src}}))"""


def _tiny(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of two messages, so that transactions are split over several."""
    return segments.segment_stats(segments.segment_by_count(stitched(spark, sf), 2))


_TINY = _MANIFEST.replace(f"/ {SEGMENT_MESSAGES})", "/ 2)")


@query(
    "segment_postfix",
    with_fixtures("stitched", body=f"SELECT * FROM {_NAMED.format(src=_TINY)}"),
)
def segment_postfix(spark: SparkSession, sf: str) -> DataFrame:
    out = segments.segment_postfix(_tiny(spark, sf))
    return out.select("relation_oid", "min_lsn", "segment_id", "postfix", "segment_name")


@query(
    "segment_order",
    with_fixtures("stitched", body=f"SELECT relation_oid, min_lsn, postfix, segment_name FROM {_NAMED.format(src=_TINY)}"),
)
def segment_order(spark: SparkSession, sf: str) -> DataFrame:
    named = segments.segment_postfix(_tiny(spark, sf))
    return segments.ordered_segments(named).select("relation_oid", "min_lsn", "postfix", "segment_name")


@query(
    "obsolete_segments",
    with_fixtures(
        "segs",
        "base",
        body="""SELECT s.relation_oid, s.sess AS session_id, s.part, s.min_lsn, s.max_lsn, b.start_lsn AS base_lsn
FROM segs s JOIN base b ON b.relation_oid = s.relation_oid WHERE s.max_lsn <= b.start_lsn""",
    ),
)
def obsolete_segments(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    out = segments.obsolete_segments(segs(log), t.base(log))
    return out.select("relation_oid", "session_id", "part", "min_lsn", "max_lsn", "base_lsn")


@query(
    "segments_union",
    with_fixtures(
        "stitched",
        "base",
        body=f"""SELECT relation_oid, segment_id, messages, CASE WHEN max_lsn > {at_share(2)} THEN 'staging' ELSE 'archive' END AS location
FROM {_MANIFEST} m""",
    ),
)
def segments_union(spark: SparkSession, sf: str) -> DataFrame:
    """Late segments lie in staging and, as older copies, in the archive too."""
    every = manifest(spark, sf)
    late = F.col("max_lsn") > t.at_share(t.chg(spark, sf), 2)
    staging = every.where(late)
    archive = every.withColumn("messages", F.when(late, 0).otherwise(F.col("messages")))
    both = segments.all_segments(staging, archive)
    return both.select("relation_oid", "segment_id", "messages", "location")


# --- state and metrics ---------------------------------------------------------------------

_MSG = "CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END"
_STATE = """(SELECT m.relation_oid, m.messages_since_base, coalesce(d.deltas_since_base, 0) AS deltas_since_base, m.last_message_us, m.final_lsn,
       greatest(coalesce(d.flushed, 0), coalesce(m.base_lsn, 0)) AS flush_lsn, m.base_lsn
FROM (SELECT c.relation_oid, count(CASE WHEN b.start_lsn IS NULL OR c.final_lsn > b.start_lsn THEN 1 END) AS messages_since_base,
             epoch_us(max(c.ts)) AS last_message_us, max(c.final_lsn) AS final_lsn, max(b.start_lsn) AS base_lsn
      FROM chg c LEFT JOIN {bases} b ON b.relation_oid = c.relation_oid GROUP BY c.relation_oid) m
LEFT JOIN (SELECT s.relation_oid, count(CASE WHEN b.start_lsn IS NULL OR s.max_lsn > b.start_lsn THEN 1 END) AS deltas_since_base, max(s.max_lsn) AS flushed
      FROM segs s LEFT JOIN {bases} b ON b.relation_oid = s.relation_oid GROUP BY s.relation_oid) d ON d.relation_oid = m.relation_oid)"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    msg = F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete")
    return (
        t.chg(spark, sf)
        .withColumnRenamed("ts", "commit_ts")
        .withColumn("msg_type", msg)
        .withColumn("bytes", F.coalesce(F.octet_length("props"), F.lit(0)))
    )


def _state(log: DataFrame, bases: DataFrame) -> DataFrame:
    return state.table_state(log, segs(log), bases)


@query("table_state", with_fixtures("chg", "segs", "base", body=f"SELECT * FROM {_STATE.format(bases='base')}"))
def table_state(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    out = _state(log, t.base(log))
    return out.withColumn("last_message_us", as_micros(F.col("last_message_ts"))).drop("last_message_ts")


@query(
    "global_flush_lsn",
    with_fixtures(
        "chg", "segs", "base", body=f"SELECT min(CASE WHEN flush_lsn <> 0 THEN flush_lsn END) AS flush_lsn FROM {_STATE.format(bases='base')}"
    ),
)
def global_flush_lsn(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return state.global_flush_lsn(_state(log, t.base(log)), strict=False)


@query(
    "flush_progress",
    with_fixtures(
        "chg",
        body="""SELECT at_us, candidate_lsn, max(candidate_lsn) OVER (ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS flush_lsn
FROM (SELECT epoch_us(ts) AS at_us, max(final_lsn - 700 * (relation_oid - 16384)) AS candidate_lsn FROM chg GROUP BY epoch_us(ts)) c""",
    ),
)
def flush_progress(spark: SparkSession, sf: str) -> DataFrame:
    history = t.chg(spark, sf).select(
        as_micros(F.col("ts")).alias("at_us"),
        (F.col("final_lsn") - 700 * (F.col("relation_oid") - 16384)).alias("flush_lsn"),
    )
    return state.flush_progress(history, at="at_us")


@query("metrics_by_type", with_fixtures("chg_ctl", body="SELECT msg_type, count(*) AS messages FROM chg_ctl GROUP BY msg_type"))
def metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return state.metrics_by_type(t.chg_ctl(t.chg(spark, sf)))


@query(
    "metrics_rollup",
    with_fixtures(
        "chg",
        body=f"""SELECT CASE WHEN grouping(relation_oid) = 1 AND grouping(msg_type) = 1 THEN 'total' WHEN grouping(relation_oid) = 1 THEN 'type'
            WHEN grouping(msg_type) = 1 THEN 'relation' ELSE 'relation_type' END AS level,
       relation_oid, msg_type, count(*) AS messages, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes, epoch_us(max(ts)) AS last_us
FROM (SELECT relation_oid, {_MSG} AS msg_type, props, ts FROM chg) c
GROUP BY GROUPING SETS ((), (msg_type), (relation_oid), (relation_oid, msg_type))""",
    ),
)
def metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    out = state.message_rollup(_log(spark, sf))
    return out.withColumn("last_us", as_micros(F.col("last_message_ts"))).drop("last_message_ts")


@query(
    "metrics_per_table",
    with_fixtures(
        "chg",
        "segs",
        "base",
        body=f"""SELECT s.relation_oid, s.messages_since_base, s.last_message_us, s.base_lsn, c.messages, c.bytes, g.segments, 0 AS idle_segments
FROM {_STATE.format(bases='base')} s
JOIN (SELECT relation_oid, count(*) AS messages, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes FROM chg GROUP BY relation_oid) c ON c.relation_oid = s.relation_oid
JOIN (SELECT relation_oid, count(*) AS segments FROM segs GROUP BY relation_oid) g ON g.relation_oid = s.relation_oid""",
    ),
)
def metrics_per_table(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    out = state.metrics_per_table(log, segs(log), t.base(log))
    return out.withColumn("last_message_us", as_micros(F.col("last_message_ts"))).drop("last_message_ts")


@query(
    "metrics_totals",
    with_fixtures(
        "messages",
        "segs",
        body="""SELECT count(*) AS messages, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes,
       count(DISTINCT CASE WHEN msg_type = 'commit' THEN final_lsn END) AS transactions,
       max(CASE WHEN msg_type = 'commit' THEN commit_us END) AS last_commit_us, max(commit_us) AS last_written_us,
       (SELECT count(*) FROM segs) AS segments FROM messages""",
    ),
)
def metrics_totals(spark: SparkSession, sf: str) -> DataFrame:
    changes = t.chg(spark, sf)
    log = transactions.stitch_transactions(t.messages(changes))
    sized = log.withColumn("bytes", F.coalesce(F.octet_length(F.get("new_row", F.lit(2))["value"]), F.lit(0)))
    out = state.metrics_totals(sized, segs(changes))
    return out.select(
        "messages",
        "bytes",
        "transactions",
        as_micros(F.col("last_commit_ts")).alias("last_commit_us"),
        as_micros(F.col("last_written_ts")).alias("last_written_us"),
        "segments",
    )


_THRESHOLD, _IDLE_SECONDS, _NOW = 20, 7200, "2030-01-01 00:00:00"


@query(
    "compaction_plan",
    with_fixtures(
        "chg",
        "segs",
        "base",
        body=f"""SELECT relation_oid, reason, messages_since_base, deltas_since_base
FROM (SELECT *, CASE WHEN base_lsn IS NULL THEN 'no_base' WHEN messages_since_base = 0 THEN NULL
                     WHEN deltas_since_base >= {_THRESHOLD} THEN 'threshold'
                     WHEN epoch_us(TIMESTAMP '{_NOW}') - last_message_us > {_IDLE_SECONDS} * 1000000 THEN 'idle' END AS reason
      FROM {_STATE.format(bases=f"(SELECT * FROM base WHERE start_lsn <= {at_share(3)})")} s) p
WHERE reason IS NOT NULL ORDER BY CASE reason WHEN 'no_base' THEN 2 WHEN 'threshold' THEN 1 ELSE 0 END DESC,
  deltas_since_base DESC, messages_since_base DESC, relation_oid LIMIT 3""",
    ),
)
def compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    bases = t.base(log).where(F.col("start_lsn") <= t.at_share(log, 3))
    # A base is as old as the last change it covers.
    taken = (
        log.join(bases, "relation_oid")
        .where("final_lsn <= start_lsn")
        .groupBy("relation_oid")
        .agg(F.max("commit_ts").cast("timestamp").alias("last_base_ts"))
    )
    current = _state(log, bases).join(taken, "relation_oid", "left")
    current = current.withColumn("last_message_ts", F.col("last_message_ts").cast("timestamp"))
    plan = state.compaction_plan(current, _THRESHOLD, _IDLE_SECONDS, F.lit(_NOW).cast("timestamp"), limit=3)
    return plan.select("relation_oid", "reason", "messages_since_base", "deltas_since_base")


# --- verification --------------------------------------------------------------------------

_A = "(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders)"
_HASH = "CAST(('0x' || substr(md5(o_orderkey || chr(9) || o_custkey || chr(9) || o_orderstatus), 1, 15)) AS BIGINT)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "fingerprint",
    with_fixtures("orders_b", body=f"SELECT count(*) AS row_count, CAST(sum({_HASH}) AS VARCHAR) AS hash_sum FROM orders_b"),
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return verify.fingerprint(t.orders_b(spark, sf))


@query("has_rows", with_fixtures("orders_b", body="SELECT count(*) > 0 AS has_rows FROM orders_b"))
def has_rows(spark: SparkSession, sf: str) -> DataFrame:
    return verify.has_rows(t.orders_b(spark, sf))


_DIFF = f"""(SELECT o_orderkey, o_custkey, o_orderstatus, CAST(sum(w) AS BIGINT) AS surplus
FROM (SELECT *, 1 AS w FROM {_A} a UNION ALL SELECT *, -1 FROM orders_b) u GROUP BY o_orderkey, o_custkey, o_orderstatus HAVING sum(w) <> 0)"""


@query("table_diff", with_fixtures("orders_b", body=f"SELECT * FROM {_DIFF} d"))
def table_diff(spark: SparkSession, sf: str) -> DataFrame:
    return verify.table_diff(_orders(spark, sf), t.orders_b(spark, sf))


@query(
    "verify_restore",
    with_fixtures(
        "orders_b",
        body=f"""SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM orders_b) AS rows_b,
       (SELECT CAST(sum({_HASH}) AS VARCHAR) FROM {_A} a) AS hash_a, (SELECT CAST(sum({_HASH}) AS VARCHAR) FROM orders_b) AS hash_b,
       (SELECT CAST(sum(abs(surplus)) AS BIGINT) FROM {_DIFF} d) AS differing, false AS equal""",
    ),
)
def verify_restore(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verify(_orders(spark, sf), t.orders_b(spark, sf))


# --- schema versions over the log ----------------------------------------------------------


@query(
    "relation_version_asof",
    with_fixtures(
        "chg",
        body="""SELECT relation_oid, lsn, op, max(CASE WHEN op = 'I' THEN lsn END) OVER (PARTITION BY relation_oid ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS version_lsn
FROM chg""",
    ),
)
def relation_version_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every insert stands for a new schema version of its relation."""
    log = t.chg(spark, sf).select("relation_oid", "lsn", "op")
    return catalog.relation_version_asof(log, log.where("op = 'I'"))


@query(
    "with_relation",
    with_fixtures(
        "chg",
        body="""SELECT relation_oid, lsn, CASE WHEN relation_oid % 2 = 0 THEN 'public' ELSE 'app' END AS namespace, 't' || relation_oid AS name, 3 AS n_columns FROM chg""",
    ),
)
def with_relation(spark: SparkSession, sf: str) -> DataFrame:
    log = t.chg(spark, sf)
    joined = catalog.with_relation(log.select("relation_oid", "lsn"), t.relations(log))
    return joined.select("relation_oid", "lsn", "namespace", "name", F.size("columns").alias("n_columns"))
