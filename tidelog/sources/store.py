"""The archive: Parquet changes, snapshots and the small tables that describe them.

Layout below ``root``::

    changes/batch_id=<n>/attempt=<a>/relation_oid=<oid>/  changes, clustered by segment
    commits/<version>.json                                which of these directories are live
    manifests/*/<id>/*.parquet                            what a commit adds, removes, or finds
    ingest_state/<id>/*.parquet                           what a batch tells the next one
    data/<oid>/<lsn>-<id>/*.parquet                       snapshot rows
    snapshots/*.parquet                                   one row per snapshot, written last
    names/version=<n>/*.parquet                           name history

Readers see a batch when its commit is there (see ``commits``), and a snapshot when its manifest
row is. Until then what was written lies beside what they read.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.types import as_text, strictly_typed
from tidelog.operators.segments import segment_stats
from tidelog.schema import CHANGES, NAME_HISTORY, SNAPSHOTS
from tidelog.session import cut_lineage
from tidelog.sources import commits

_MANIFEST = threading.Lock()


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """Parquet below ``path``, or None where nothing was written yet."""
    reader = spark.read.option("basePath", path)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_segments(
    changes: DataFrame, root: str, batch_id: int = 0, ingest_state: str | None = None
) -> DataFrame:
    """Store changes that carry ``segment_id`` as one commit; returns its manifest rows.

    Rows are rebalanced by segment, so that a hot relation is spread over many files of
    even size, and sorted by it, so that readers skip row groups by position. A repeated batch
    takes the place of its earlier attempt in the same commit. ``ingest_state``: path of the
    state that belongs to the batch."""
    spark = changes.sparkSession
    path = f"{root}/changes/batch_id={batch_id}/attempt=a{uuid.uuid4().hex}"
    clustered = changes.hint("rebalance", F.col("relation_oid"), F.col("segment_id"))
    clustered.sortWithinPartitions("relation_oid", "segment_id", "pos").write.partitionBy("relation_oid").parquet(path)
    # The schema is given: a batch may hold nothing new and then has no files.
    stored = spark.read.schema(changes.schema).parquet(path)
    manifest = segment_stats(stored).withColumns({
        "path": F.concat(F.lit(f"{path}/relation_oid="), F.col("relation_oid").cast("string")),
        "batch_id": F.lit(batch_id).cast("bigint"),
    })
    manifest = cut_lineage(manifest)
    live = commits.live_segments(spark, root)
    earlier = None
    if live is not None:
        earlier = live.where(F.col("batch_id") == batch_id).select("path").distinct()
        earlier = None if earlier.isEmpty() else cut_lineage(earlier)
    commits.commit(spark, root, "batch", manifest, earlier, None if ingest_state is None else (batch_id, ingest_state))
    return manifest


def read_segment_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """Segments that are live."""
    return commits.live_segments(spark, root)


def _of(live: DataFrame, relation_oid: int | None, after_lsn: int | None, upto_lsn: int | None = None) -> DataFrame:
    """Segments that hold changes of a relation in a range of positions, or schema messages."""
    if relation_oid is not None:
        live = live.where(F.col("relation_oid") == relation_oid)
    if after_lsn is not None:
        live = live.where((F.col("max_lsn") > after_lsn) | F.col("max_lsn").isNull())
    if upto_lsn is not None:
        live = live.where((F.col("min_lsn") <= upto_lsn) | F.col("min_lsn").isNull())
    return live


def read_directories(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Stored changes of some directories."""
    return spark.read.option("basePath", f"{root}/changes").parquet(*paths).drop("attempt")


def read_changes(
    spark: SparkSession, root: str, relation_oid: int | None = None, after_lsn: int | None = None, upto_lsn: int | None = None
) -> DataFrame | None:
    """Stored changes. Relation and positions pick the directories to open, by the commit log, and
    reach the scan of those.

    Changes without a header position are schema messages and always stay."""
    live = commits.live_segments(spark, root)
    if live is None:
        return None
    # Metadata: one path per batch and relation that the bounds leave, few after a merge.
    paths = [r["path"] for r in _of(live, relation_oid, after_lsn, upto_lsn).select("path").distinct().collect()]
    if not paths:
        any_path = live.select("path").first()
        if any_path is None:
            return None
        return read_directories(spark, root, [any_path["path"]]).where("false")
    changes = read_directories(spark, root, paths)
    if after_lsn is not None:
        changes = changes.where((F.col("final_lsn") > after_lsn) | F.col("final_lsn").isNull())
    if upto_lsn is not None:
        changes = changes.where((F.col("final_lsn") <= upto_lsn) | F.col("final_lsn").isNull())
    return changes


def merge_batches(spark: SparkSession, root: str, fan: int = 8) -> int:
    """Merge small directories of a relation into larger ones, in one commit; how many went into it.

    Directories are of one tier if their message counts have the same power of ``fan``. Once a
    relation has ``fan`` of a tier they become one of the next, so a change is rewritten once per
    tier. The newest batch stays as it is, since it may be repeated. Segments keep their names and
    statistics; only where they lie changes. What was merged away stays on disk for readers that
    still use it, until ``clean``."""
    version = commits.newest_version(spark, root)
    live = commits.live_segments(spark, root, version) if version else None
    newest = None if live is None else live.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return 0
    per = live.where(F.col("batch_id") < newest).groupBy("path", "relation_oid", "batch_id").agg(F.sum("messages").alias("messages"))
    tier = F.floor(F.log(F.greatest("messages", F.lit(1)).cast("double")) / F.log(F.lit(float(fan))) + 1e-9)
    per = cut_lineage(per.withColumn("tier", tier))
    full = per.groupBy("relation_oid", "tier").agg(F.count("*").alias("n")).where(F.col("n") >= fan)
    chosen = cut_lineage(per.join(full.select("relation_oid", "tier"), ["relation_oid", "tier"], "left_semi"))
    paths = [r["path"] for r in chosen.select("path").collect()]
    if not paths:
        return 0
    last = chosen.agg(F.max("batch_id")).first()[0]
    target = f"{root}/changes/batch_id={last}/attempt=m{uuid.uuid4().hex}"
    # Tiers of a relation lie in directories of their own, so that each keeps its size.
    rows = read_directories(spark, root, paths)
    moved = cut_lineage(
        chosen.select("path", "relation_oid", "batch_id", F.concat_ws("/", F.lit(target), F.concat(F.lit("relation_oid="), F.col("relation_oid").cast("string"))).alias("target"))
    )
    rows.drop("batch_id").hint("rebalance", F.col("relation_oid"), F.col("segment_id")).sortWithinPartitions(
        "relation_oid", "segment_id", "pos"
    ).write.partitionBy("relation_oid").parquet(target)
    entries = live.join(moved.select("path", "target"), "path").withColumns({"path": F.col("target"), "batch_id": F.lit(last).cast("bigint")})
    commits.commit(spark, root, "merge", entries, moved.select("path"))
    return len(paths)


def clean(spark: SparkSession, root: str) -> int:
    """Delete, by tasks, directories that no version from the newest whole table on has live."""
    version = commits.newest_version(spark, root)
    first = version - version % commits.EVERY
    old = [v for v in range(max(1, first - commits.EVERY), first + 1)] if first else []
    removed = [c["removed"] for c in (commits.read_commit(spark, root, v) for v in old) if c["removed"]]
    return commits.delete_directories(spark.read.parquet(*removed)) if removed else 0


def write_snapshot(df: DataFrame, relation: Row, start_lsn: int, root: str) -> str:
    """Store a full snapshot: rows first, the manifest row last.

    ``relation`` describes the table (fields of the relations schema). Rows are kept in the
    text form of the log, which loses no value and compares with the changes after it."""
    spark = df.sparkSession
    began = time.time()
    oid = relation["relation_oid"]
    path = f"{root}/data/{oid}/{start_lsn:016x}-{uuid.uuid4().hex[:8]}"
    as_text(df, relation["columns"]).write.mode("errorifexists").parquet(path)
    row = Row(**{n: relation[n] for n in ("relation_oid", "lsn", "namespace", "name", "replica_identity", "columns")})
    entry = spark.createDataFrame(
        [(oid, start_lsn, None, time.time() - began, row, path)], SNAPSHOTS
    ).withColumn("created_at", F.current_timestamp())
    # Jobs of several tables may run side by side; two commits into one directory must not.
    with _MANIFEST:
        entry.coalesce(1).write.mode("append").parquet(f"{root}/snapshots")
    return path


def read_snapshot(spark: SparkSession, snapshot: Row, text: bool = False) -> DataFrame:
    """Rows of one snapshot in text form, or typed; then a text without a value of its type
    fails the job (``typed_or_text`` keeps such columns as text)."""
    columns = snapshot["relation"]["columns"]
    rows = spark.read.parquet(snapshot["path"])
    return rows if text else strictly_typed(rows, columns)


def read_snapshots(spark: SparkSession, root: str) -> DataFrame | None:
    return _read(spark, f"{root}/snapshots")


def latest_snapshots(snapshots: DataFrame, at_lsn: int | None = None) -> DataFrame:
    """Newest snapshot of each relation at or before a position."""
    if at_lsn is not None:
        snapshots = snapshots.where(F.col("start_lsn") <= at_lsn)
    rest = [c for c in snapshots.columns if c not in ("relation_oid", "start_lsn")]
    newest = snapshots.groupBy("relation_oid").agg(
        F.max_by(F.struct("start_lsn", *rest), F.struct("start_lsn", *[c for c in rest if c == "created_at"])).alias("__s")
    )
    return newest.select("relation_oid", "__s.start_lsn", *[F.col(f"__s.{c}").alias(c) for c in rest])


def latest_snapshot(spark: SparkSession, root: str, oid: int, at_lsn: int | None = None) -> Row | None:
    """Manifest row of the snapshot a restore starts from."""
    snapshots = read_snapshots(spark, root)
    if snapshots is None:
        return None
    return latest_snapshots(snapshots.where(F.col("relation_oid") == oid), at_lsn).first()


def read_name_history(spark: SparkSession, root: str) -> DataFrame | None:
    versions = _read(spark, f"{root}/names")
    if versions is None:
        return None
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def write_name_history(history: DataFrame, root: str) -> bool:
    """Store the name history as a new version, only if it differs from the last one."""
    spark = history.sparkSession
    columns = [f.name for f in NAME_HISTORY.fields]
    history = history.select(*columns)
    previous = read_name_history(spark, root)
    version = 1
    if previous is not None:
        previous = previous.select(*columns)
        both = history.withColumn("__w", F.lit(1)).unionByName(previous.withColumn("__w", F.lit(-1)))
        if both.groupBy(*columns).agg(F.sum("__w").alias("w")).where("w <> 0").isEmpty():
            return False
        version = _read(spark, f"{root}/names").agg(F.max("version")).first()[0] + 1
    history.write.mode("errorifexists").parquet(f"{root}/names/version={version}")
    return True


def _stored_state(spark: SparkSession, root: str) -> DataFrame | None:
    path = commits.ingest_state(spark, f"{root}/state")
    return None if path is None else spark.read.parquet(path)


def write_table_state(state: DataFrame, root: str) -> int:
    """Store the table state (derived data, kept for readers of the archive) as the next version.

    A version holds all tables: those that ``state`` leaves out keep their last row. Its number is
    taken by a commit, so two writers never take the same one."""
    spark = state.sparkSession
    before = _stored_state(spark, root)
    if before is not None:
        kept = before.join(state.select("relation_oid"), "relation_oid", "left_anti")
        state = state.unionByName(kept.select(*state.columns))
    path = f"{root}/state/rows/{uuid.uuid4().hex}"
    state.write.parquet(path)
    return commits.commit(spark, f"{root}/state", "state", ingest=(commits.newest_version(spark, f"{root}/state") + 1, path))


def read_table_state(spark: SparkSession, staging: str | None, archive: str) -> DataFrame | None:
    """Newest stored state per table; the staging copy wins over the archived one."""
    staged, archived = (None if root is None else _stored_state(spark, root) for root in (staging, archive))
    if staged is None or archived is None:
        return archived if staged is None else staged
    rest = archived.join(staged.select("relation_oid"), "relation_oid", "left_anti")
    return staged.unionByName(rest.select(*staged.columns))


def empty_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHANGES)
