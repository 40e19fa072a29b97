"""Transactions: carrying headers, numbering, committed-only, fan-out of control messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.lookup import join_small, where_key, with_value
from tidelog.operators.scan import Last, RowNumber, ordered_scan
from tidelog.schema import DML_TYPES
from tidelog.session import cut_lineage


def by_type(changes: DataFrame, *types: str) -> DataFrame:
    return changes.where(F.col("msg_type").isin(*types))


def dml_only(changes: DataFrame) -> DataFrame:
    return by_type(changes, *DML_TYPES)


def stitch_transactions(changes: DataFrame, **scan) -> DataFrame:
    """Give every message the header of the transaction it belongs to.

    ``pos`` is the delivery position inside the relation's stream. Headers come only with
    ``begin``; they are carried forward, across segments, to the commit. Adds ``tx_pos``,
    the position of that ``begin``, which tells two deliveries of a transaction apart.
    """
    header_columns = [c for c in ("xid", "final_lsn", "commit_ts") if c in changes.columns]
    header = F.when(
        F.col("msg_type") == "begin", F.struct(*header_columns, F.col("pos").alias("tx_pos"))
    )
    scanned = ordered_scan(changes, ["relation_oid"], ["pos"], [Last("__header", header)], **scan)
    kept = [c for c in changes.columns if c not in (*header_columns, "tx_pos")]
    return scanned.select(
        *kept, *[F.col(f"__header.{c}").alias(c) for c in header_columns], F.col("__header.tx_pos").alias("tx_pos")
    )


def with_seq(changes: DataFrame, tx: Sequence[str] = ("relation_oid", "final_lsn"), **scan) -> DataFrame:
    """Position of each message inside its transaction, from 1, per relation.

    A single transaction may hold most of a log, so the numbering is a blocked scan too."""
    out = ordered_scan(changes, list(tx), ["pos"], [RowNumber("seq")], **scan)
    return out.withColumn("seq", F.col("seq").cast("int"))


def committed(changes: DataFrame) -> DataFrame:
    """Messages of transactions that have a commit; an open tail takes no effect.

    Open transactions are few, one per relation as a rule. They are found in one narrow
    aggregate and written, so Spark knows how few and leaves the log itself where it is."""
    headed = changes.where("final_lsn is not null")
    tail = (
        headed.groupBy("relation_oid", "final_lsn")
        .agg(F.bool_or(F.col("msg_type") == "commit").alias("done"))
        .where("not done")
        .select("relation_oid", "final_lsn")
    )
    return headed.join(cut_lineage(tail), ["relation_oid", "final_lsn"], "left_anti")


def touched(changes: DataFrame) -> DataFrame:
    """Relations each transaction touched. A transaction is named by its id and its end: ids
    alone are 32-bit counters that wrap."""
    return changes.select("xid", "final_lsn", "relation_oid").distinct()


def fan_out_control(control: DataFrame, touched_relations: DataFrame) -> DataFrame:
    """One begin and one commit for exactly the relations a transaction touched."""
    return control.drop("relation_oid").join(touched_relations, ["xid", "final_lsn"])


def tx_summary(changes: DataFrame, bytes_column: str | None = "bytes") -> DataFrame:
    """Messages, relations, bytes and commit time per transaction.

    Counted per relation first: the distinct count then is a plain count over few rows, and
    a huge transaction is summed map-side."""
    size = F.sum(bytes_column) if bytes_column else F.lit(None).cast("bigint")
    per_relation = changes.groupBy("xid", "final_lsn", "relation_oid").agg(
        F.count("*").alias("messages"), size.alias("bytes"), F.max("commit_ts").alias("commit_ts")
    )
    return per_relation.groupBy("xid", "final_lsn").agg(
        F.sum("messages").alias("messages"),
        F.count("*").alias("tables"),
        F.sum("bytes").alias("bytes"),
        F.max("commit_ts").alias("commit_ts"),
    )


def dedupe(changes: DataFrame, identity: Sequence[str] = ("relation_oid", "final_lsn", "seq")) -> DataFrame:
    """Drop messages delivered again after a restart: one row per message identity.

    Copies of a message are equal but for ``pos`` and ``tx_pos``; the first delivery stays. A
    transaction is delivered again from its begin, so ``tx_pos`` tells its deliveries apart. Only
    transactions with several deliveries are compared, by the range of ``seq`` each delivery holds: a
    message goes if an earlier one's range has it. All else stays in its partition, and no payload is
    aggregated. Rows without a transaction header have no identity and are all kept.

    Without ``tx_pos`` the copies are told by their identities alone, which are counted first.
    """
    tx = [c for c in identity if c != "seq"]
    headed = changes.where("final_lsn is not null")
    if "tx_pos" in changes.columns:
        held = cut_lineage(headed.groupBy(*tx, "tx_pos").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n")))
        counts = held.groupBy(*tx).agg(F.sum("n").alias("n"))
        again = held.groupBy(*tx).agg(F.array_sort(F.collect_list(F.struct("tx_pos", "lo", "hi"))).alias("__held")).where("size(__held) > 1")
        earlier = F.exists("__held", lambda h: (h["tx_pos"] < F.col("tx_pos")) & F.col("seq").between(h["lo"], h["hi"]))
    else:
        again = headed.groupBy(*identity).agg(F.count("*").alias("n"), F.min("pos").alias("__held")).where("n > 1").drop("n")
        counts = None
        tx, earlier = list(identity), F.col("pos") > F.col("__held")
    again = cut_lineage(again)
    if again.isEmpty():
        return changes
    return join_small(changes, again, tx, counts=counts).where(~F.coalesce(earlier, F.lit(False))).select(*changes.columns)


def after_base(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes a restore has to replay: later than the relation's base, or without any base.

    ``snapshots`` holds one row per relation (see ``latest_snapshots``)."""
    bases = snapshots.select("relation_oid", F.col("start_lsn").alias("__base"))
    return with_value(changes, bases, "__base").where("__base is null or final_lsn > __base").drop("__base")


def drop_superseded(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Changes that ingest stores: everything not older than the base (equal is stored)."""
    bases = snapshots.select("relation_oid", F.col("start_lsn").alias("__base"))
    return with_value(changes, bases, "__base").where("__base is null or final_lsn >= __base").drop("__base")


def tracked(changes: DataFrame, tables: DataFrame) -> DataFrame:
    return where_key(changes, tables)


def orphans(changes: DataFrame, tables: DataFrame) -> DataFrame:
    """Changes of relations nobody registered."""
    return where_key(changes, tables, inside=False)


def explode_truncate(changes: DataFrame) -> DataFrame:
    """A truncate concerns every relation it lists."""
    return changes.where("msg_type = 'truncate'").withColumn("relation_oid", F.explode("relation_oids"))


def ordered_changes(changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Log order for inspection and export: range partitions, sorted inside each."""
    order = ["relation_oid", "final_lsn", "pos"]
    ranged = changes.repartitionByRange(partitions, *order) if partitions else changes.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)
