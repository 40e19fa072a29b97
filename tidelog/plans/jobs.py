"""Jobs users call: restore, compact, purge, plan, inspect, verify."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.types import canonical_text, spark_type, typed_or_text
from tidelog.operators import catalog, replay, segments, transactions, verify as verification
from tidelog.operators.render import inspect as inspect_lines
from tidelog.operators.scan import Prev, ordered_scan
from tidelog.schema import RELATIONS
from tidelog.session import cut_lineage
from tidelog.sources import commits, store
from tidelog.sources.segments import read_segments
from tidelog.sources.wire import decode_messages


@dataclass
class Restored:
    """Rows of a table in the text form of the log, and how they came about.

    ``rows`` are typed. A column with values that Spark's type cannot hold stays text, and
    ``uncastable`` says how many it has."""

    text: DataFrame
    relation: Row
    start_lsn: int | None

    @cached_property
    def _typed(self) -> tuple[DataFrame, dict[str, int]]:
        columns = self.relation["columns"]
        # Replayed once: the text is written, then counted and converted from there.
        plain = all(spark_type(c["type_oid"], c["typmod"]) == "string" for c in columns)
        return typed_or_text(self.text if plain else cut_lineage(self.text), columns)

    @property
    def rows(self) -> DataFrame:
        return self._typed[0]

    @property
    def uncastable(self) -> dict[str, int]:
        return self._typed[1]


def relations_of(changes: DataFrame) -> DataFrame:
    """Relation messages of a decoded log as schema versions."""
    return changes.where("msg_type = 'relation'").select(
        "relation_oid",
        F.coalesce("final_lsn", F.lit(0)).cast("bigint").alias("lsn"),
        "namespace",
        "name",
        "replica_identity",
        "columns",
    )


def read_log(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Binary segments to stitched, de-duplicated changes."""
    frames = read_segments(spark, path, mode).select("relation_oid", "pos", "raw")
    stitched = transactions.stitch_transactions(decode_messages(frames, mode), levels=2)
    numbered = transactions.with_seq(stitched.withColumn("tx_pos", F.coalesce("tx_pos", F.lit(-1))), ("relation_oid", "tx_pos"))
    return transactions.dedupe(numbered)


def resolve_table(spark: SparkSession, root: str, namespace: str, name: str, at_lsn: int = 0) -> int:
    history = store.read_name_history(spark, root)
    if history is None:
        raise LookupError("the archive has no name history")
    entries = history.where((F.col("namespace") == namespace) & (F.col("name") == name))
    if at_lsn:
        entries = entries.where(F.col("lsn") <= at_lsn)
    # Newest entry first; of two tables that took the name at once, the lower id.
    found = entries.orderBy(F.desc("lsn"), F.asc("relation_oid")).select("relation_oid").first()
    if found is None:
        raise LookupError(f"no table {namespace}.{name} at position {at_lsn or 'any'}")
    return found["relation_oid"]


def _lsn_at(changes: DataFrame, at_ts) -> int | None:
    """Newest commit position before the first commit that is later than a time.

    Commit times need not grow with positions. Stopping at the first later one restores a
    state the table really had, and nothing committed after ``at_ts``."""
    commits = changes.where((F.col("msg_type") == "commit") & F.col("final_lsn").isNotNull())
    later = F.min(F.when(F.col("commit_ts") > F.lit(at_ts), F.col("final_lsn")))
    first = commits.agg(later).first()[0]
    upto = commits if first is None else commits.where(F.col("final_lsn") < first)
    return upto.agg(F.max("final_lsn")).first()[0]


def _before_later(spark: SparkSession, root: str, oid: int, at_ts) -> int | None:
    """A position before the first commit that is later than a time, or None if there is none.

    The manifest has the latest commit time of each segment, so the log is read only from the
    first segment on that holds a later one. Commit times need not grow with positions: nothing
    at or after that commit is restored, and so nothing that was committed after ``at_ts``."""
    live = store.read_segment_manifest(spark, root)
    if live is None:
        return None
    later = live.where((F.col("relation_oid") == oid) & (F.col("max_ts") > F.lit(at_ts)))
    low = later.agg(F.min("min_lsn")).first()[0]
    if low is None:
        return None
    commits_ = store.read_changes(spark, root, oid, after_lsn=low - 1).where("msg_type = 'commit' and final_lsn is not null")
    first = commits_.where(F.col("commit_ts") > F.lit(at_ts)).agg(F.min("final_lsn")).first()[0]
    return None if first is None else first - 1


def restore_table(
    spark: SparkSession,
    root: str,
    oid: int,
    at_lsn: int | None = None,
    at_ts=None,
    expected: Row | None = None,
    replay_from_base: bool = True,
) -> Restored:
    """Rows of a table as of a position: its newest snapshot, then the later committed changes.

    ``expected`` is the schema of the table to restore into; a difference is an error.
    """
    if at_ts is not None:
        found = _before_later(spark, root, oid, at_ts)
        if found is not None:
            at_lsn = found if at_lsn is None else min(at_lsn, found)
    snapshot = store.latest_snapshot(spark, root, oid, at_lsn) if replay_from_base else None
    start = None if snapshot is None else snapshot["start_lsn"]
    log = store.read_changes(spark, root, oid, after_lsn=start, upto_lsn=at_lsn)
    if log is None:
        log = store.empty_changes(spark)

    effective = _effective(spark, root, log, oid)
    layouts, barrier = _layouts(log, effective, None if snapshot is None else snapshot["relation"])
    if not layouts:
        raise LookupError(f"no schema for table {oid}")
    relation = layouts[-1][1]
    if expected is not None:
        pair = [spark.createDataFrame([_as_relation(r)], schema=RELATIONS) for r in (relation, expected)]
        differences = catalog.schema_mismatches(*pair)
        if not differences.isEmpty():
            raise ValueError(f"tables are different: {[r.asDict() for r in differences.take(20)]}")

    # Ingest has routed every truncate to each relation it lists.
    rows = effective.where(F.col("msg_type").isin("insert", "update", "delete"))
    if barrier is not None:
        rows = rows.where(F.struct(*replay.ORDER) > F.struct(*[F.lit(barrier[c]).cast(rows.schema[c].dataType).alias(c) for c in replay.ORDER]))
    text = None
    if snapshot is not None:
        text = store.read_snapshot(spark, snapshot, text=True)
        # A later truncate removes all of them.
        text = text if barrier is None else text.where("false")
    groups = _key_groups(layouts)
    for i, spans in enumerate(groups):
        text = _image(rows, spans, text, oid, start)
        if i + 1 < len(groups):
            # Another key from here on: the image goes on as inserts under it.
            text = cut_lineage(text)
    return Restored(text, relation, start)


def _image(rows: DataFrame, spans: list, text: DataFrame | None, oid: int, start: int | None) -> DataFrame:
    """Rows of a table after the changes of some spans, all of one key, and the rows before them (or None)."""
    columns = spans[-1][2]["columns"]
    names = [c["name"] for c in columns]
    if text is not None:
        # Columns added since are null in earlier rows.
        text = text.select(*[(F.col(n) if n in text.columns else F.lit(None).cast("string")).alias(n) for n in names])
        text = text.withColumn("relation_oid", F.lit(oid).cast("bigint")).withColumn("start_lsn", F.lit(start or 0).cast("bigint"))
    if _keyed(spans[-1][2]):
        changes = None
        for low, high, layout in spans:
            part, keys, _ = replay.row_changes(_between(rows, low, high), layout["columns"])
            part = _as_layout(part, columns)
            changes = part if changes is None else changes.unionByName(part)
        keys, data = [c["name"] for c in columns if c["is_key"]], [c["name"] for c in columns if not c["is_key"]]
        if text is not None:
            changes = replay.base_plus_tail(text, changes, ["relation_oid", *keys], data)
        # Keys of the snapshot and of the log may be written differently.
        for c in columns:
            if c["is_key"]:
                for k in (c["name"], f"old_{c['name']}"):
                    changes = changes.withColumn(k, canonical_text(F.col(k), c["type_oid"], c["typmod"]))
        return replay.replay(changes, ["relation_oid", *keys], data).select(*names)
    signed = None
    for low, high, layout in spans:
        part = replay.signed_rows(_between(rows, low, high), layout["columns"])
        have = set(part.columns)
        part = part.select(*[(F.col(n) if n in have else F.lit(None).cast("string")).alias(n) for n in names], "w")
        signed = part if signed is None else signed.unionByName(part)
    if text is not None:
        signed = signed.unionByName(text.select(*names, F.lit(1).cast("bigint").alias("w")))
    signed = signed.select(
        *[canonical_text(F.col(c["name"]), c["type_oid"], c["typmod"]).alias(c["name"]) for c in columns], "w"
    )
    return replay.replay_full(signed, names).select(*names)


def _keyed(relation: Row) -> bool:
    return any(c["is_key"] for c in relation["columns"]) and relation["replica_identity"] != "n"


def _key_groups(layouts: list) -> list[list]:
    """Spans with one column layout each, as runs that have the same key."""
    groups: list[list] = []
    before = None
    for span in _spans(layouts):
        key = sorted(c["name"] for c in span[2]["columns"] if c["is_key"]) if _keyed(span[2]) else None
        if not groups or key != before:
            groups.append([])
        groups[-1].append(span)
        before = key
    return groups


def _effective(spark: SparkSession, root: str, log: DataFrame, oid: int) -> DataFrame:
    """Changes of committed transactions. A table's transactions follow one another, so those up to
    the position that the ingest state has as committed are; an archive without a state is counted."""
    path = commits.ingest_state(spark, root)
    if path is None:
        return transactions.committed(log)
    known = spark.read.parquet(path).where(F.col("relation_oid") == oid).select("committed_lsn").first()
    upto = None if known is None else known["committed_lsn"]
    return log.where(F.col("final_lsn") <= upto) if upto is not None else log.where("false")


def _layouts(log: DataFrame, effective: DataFrame, pinned: Row | None) -> tuple[list[tuple[int | None, Row]], Row | None]:
    """Schemas in force along a table's log (the position each one starts at, and the schema), and
    where its newest truncate stands.

    The snapshot pins the first schema. Schema changes are few and are read to the driver;
    messages that repeat the schema in force are dropped before that. Without a snapshot,
    schemas sent outside any transaction count too.
    """
    sent = effective.where("msg_type in ('relation', 'truncate')")
    if pinned is None:
        sent = sent.unionByName(log.where("msg_type = 'relation' and final_lsn is null"))
    version = ["namespace", "name", "replica_identity", "columns"]
    lsn = F.coalesce("final_lsn", F.lit(0)).cast("bigint").alias("lsn")
    # One row per schema, and one for all truncates: usually two at most.
    found = sent.select("msg_type", "relation_oid", "pos", "seq", "final_lsn", lsn, *version).groupBy("msg_type", *version).agg(
        F.min("pos").alias("pos"), F.min_by("relation_oid", "pos").alias("relation_oid"), F.min_by("lsn", "pos").alias("lsn"),
        F.max(F.struct(*replay.ORDER)).alias("at"),
    ).collect()
    barrier = max((r["at"] for r in found if r["msg_type"] == "truncate"), default=None)
    one = [r for r in found if r["msg_type"] == "relation"]
    if len(one) < 2:
        # The usual case: one schema all along.
        if pinned is not None:
            return [(None, pinned), *[(r["pos"], r) for r in one]], barrier
        return [(None, r) for r in one], barrier
    sent = sent.where("msg_type = 'relation'").select("relation_oid", "pos", lsn, *version)
    marked = ordered_scan(sent, ["relation_oid"], ["pos"], [Prev("__prev", F.struct(*version))])
    changed = marked.where(~F.col("__prev").eqNullSafe(F.struct(*version))).orderBy("pos").collect()
    layouts = [(r["pos"], r) for r in changed]
    if pinned is not None:
        return [(None, pinned), *layouts], barrier
    return [(None, layouts[0][1]), *layouts[1:]] if layouts else [], barrier


def _spans(layouts: list[tuple[int | None, Row]]):
    """Position ranges with one column layout each, as (from, to, schema)."""
    merged: list[tuple[int | None, Row]] = []
    for start, relation in layouts:
        if not merged or merged[-1][1]["columns"] != relation["columns"]:
            merged.append((start, relation))
    for i, (start, relation) in enumerate(merged):
        yield start, merged[i + 1][0] if i + 1 < len(merged) else None, relation


def _between(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    if low is not None:
        rows = rows.where(F.col("pos") >= low)
    if high is not None:
        rows = rows.where(F.col("pos") < high)
    return rows


def _as_layout(part: DataFrame, columns: Sequence) -> DataFrame:
    """Row changes of an older layout with the same key under the newest one: dropped columns
    go, columns added later are null."""
    wanted = [c["name"] for c in columns if c["is_key"]]
    have = set(part.columns)
    out = [F.col(c) for c in ("relation_oid", *replay.ORDER, "op", *wanted, *[f"old_{k}" for k in wanted])]
    for c in columns:
        if c["is_key"]:
            continue
        name = c["name"]
        if name in have:
            out += [F.col(name), F.col(f"{name}__kind")]
        else:
            out += [F.lit(None).cast("string").alias(name), F.when(F.col("op") != "D", "n").alias(f"{name}__kind")]
    return part.select(*out)


def _as_relation(row: Row) -> tuple:
    return tuple(row[n] for n in ("relation_oid", "lsn", "namespace", "name", "replica_identity", "columns"))


def restore(
    spark: SparkSession,
    root: str,
    namespace: str,
    name: str,
    target: str | None = None,
    mode: str = "append",
    at_lsn: int | None = None,
    at_ts=None,
    expected: Row | None = None,
    casts: str = "PERMISSIVE",
) -> DataFrame:
    """Restore a table by name; with ``target``, write it there (``append`` or ``overwrite``).

    A column with values that have no Spark value is restored as text; with
    ``casts="FAILFAST"`` it stops the restore instead."""
    oid = resolve_table(spark, root, namespace, name, at_lsn or 0)
    restored = restore_table(spark, root, oid, at_lsn, at_ts, expected)
    rows = restored.rows
    if casts == "FAILFAST" and restored.uncastable:
        raise ValueError(f"values without a Spark value, per column: {restored.uncastable}")
    if target is None:
        return rows
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    rows.write.mode(mode).parquet(target)
    return spark.read.parquet(target)


def compact(spark: SparkSession, root: str, oid: int, upto_lsn: int | None = None) -> int:
    """Write a new snapshot from the last one and the changes up to a committed position; returns
    the position. Only changes after the last snapshot are read; without any it stays the newest."""
    last = store.latest_snapshot(spark, root, oid, upto_lsn)
    base = None if last is None else last["start_lsn"]
    log = store.read_changes(spark, root, oid, after_lsn=base, upto_lsn=upto_lsn)
    found = None
    if log is not None:
        found = log.where("msg_type = 'commit' and final_lsn is not null").agg(F.max("final_lsn")).first()[0]
    start_lsn = base if found is None else found
    if start_lsn is None:
        raise LookupError(f"no committed changes of table {oid} up to {upto_lsn}")
    if start_lsn == base:
        return base
    restored = restore_table(spark, root, oid, at_lsn=start_lsn)
    store.write_snapshot(restored.text, restored.relation, start_lsn, root)
    return start_lsn


def _side_by_side(run, items: Sequence, at_once: int) -> list:
    """Spark jobs of several tables at a time; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return list(pool.map(run, items))


def compact_due(spark: SparkSession, root: str, plan: DataFrame, at_once: int = 5) -> dict[int, int]:
    """Carry out a snapshot plan (see ``state.compaction_plan``): new snapshots of its tables,
    several at a time. Position of each one; tables without a committed change are left out.

    Meant to run beside an ingest, not inside its batches. A plan has one row per table that
    is due, and a limit of its own."""

    def one(oid: int) -> int | None:
        try:
            return compact(spark, root, oid)
        except LookupError:
            return None

    oids = [r["relation_oid"] for r in plan.select("relation_oid").collect()]
    return {oid: lsn for oid, lsn in zip(oids, _side_by_side(one, oids, at_once)) if lsn is not None}


def initial_base(
    spark: SparkSession, relations: Sequence[Row], read_table, start_lsn: int, root: str, at_once: int = 5
) -> DataFrame:
    """A first snapshot of every table of a publication. ``read_table(relation)`` gives the
    table's rows, e.g. from ``spark.read.jdbc``; every table is a Spark job of its own, and
    ``at_once`` of them run side by side."""
    _side_by_side(lambda r: store.write_snapshot(read_table(r), r, start_lsn, root), relations, at_once)
    return store.read_snapshots(spark, root)


def purge(spark: SparkSession, root: str, dry_run: bool = True) -> DataFrame:
    """Change directories that the newest snapshots supersede.

    The unit is one relation in one batch: it goes once all its segments are obsolete, so a
    restore at or after the base never misses a change. Unless ``dry_run``, the directories
    leave the commit log first and are removed afterwards, by tasks.
    """
    manifest = store.read_segment_manifest(spark, root)
    snapshots = store.latest_snapshots(store.read_snapshots(spark, root))
    per_directory = manifest.groupBy("batch_id", "relation_oid", "path").agg(
        F.min("min_lsn").alias("min_lsn"),
        # Segments without a position hold schema messages only and have no upper bound.
        F.max(F.coalesce("max_lsn", F.lit(0))).alias("max_lsn"),
        F.count("*").alias("segments"),
    )
    obsolete = segments.obsolete_segments(per_directory, snapshots)
    if not dry_run:
        obsolete = cut_lineage(obsolete)
        if not obsolete.isEmpty():
            commits.commit(spark, root, "purge", removed=obsolete)
            commits.delete_directories(obsolete)
    return obsolete


def promote_segments(spark: SparkSession, staging: str, archive: str, snapshots: DataFrame, batch_id: int = 0) -> DataFrame:
    """Copy staged segments to the archive, without those the bases supersede, and audit the
    copy: one row per segment, ``ok`` where rows and content agree. The staging copy may go
    once all are ok."""
    manifest = store.read_segment_manifest(spark, staging)
    live = segments.live_segments(manifest, snapshots).select("relation_oid", "segment_id")
    staged = store.read_changes(spark, staging).drop("batch_id")
    source = staged.join(live, ["relation_oid", "segment_id"], "left_semi")
    written = store.write_segments(source, archive, batch_id)
    paths = [r["path"] for r in written.select("path").distinct().collect()]
    target = store.read_directories(spark, archive, paths) if paths else source.where("false")
    return segments.audit(source, target.select(*source.columns))


def inspect(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Lines that describe the messages of binary segments, in order of ``pos``."""
    frames = read_segments(spark, path, mode)
    return inspect_lines(decode_messages(frames, mode)).select("relation_oid", "segment_name", "pos", "line")


def verify(a: DataFrame, b: DataFrame) -> DataFrame:
    return verification.verify(a, b)
