"""Joins of a log with one row per relation: literals, broadcast, salted; and redeliveries by ranges."""

import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import catalog, lookup, replay, transactions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def log(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("bigint").alias("relation_oid"),
        F.col("id").alias("final_lsn"), F.col("id").alias("pos"), F.lit(1).alias("seq"), F.lit("insert").alias("msg_type"),
    )


@pytest.mark.parametrize("literals, broadcast", [(500, 20_000), (0, 20_000), (0, 0)])
def test_no_way_shuffles_the_log_by_relation(spark, monkeypatch, literals, broadcast):
    monkeypatch.setattr(lookup, "LITERALS", literals)
    monkeypatch.setattr(lookup, "BROADCAST", broadcast)
    bases = spark.createDataFrame([(7, 1500), (1, 2990), (9, None)], "relation_oid long, start_lsn long")
    tables = spark.createDataFrame([(7,), (2,), (None,)], "relation_oid long")
    relations = spark.createDataFrame([(i, f"t{i}") for i in range(11)], "relation_oid long, name string")
    rows = [(r.relation_oid, r.final_lsn) for r in log(spark).collect()]
    low = {7: 1500, 1: 2990}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, want in (
            (transactions.after_base(log(spark), bases), [x for x in rows if x[1] > low.get(x[0], -1)]),
            (transactions.drop_superseded(log(spark), bases), [x for x in rows if x[1] >= low.get(x[0], -1)]),
            (transactions.tracked(log(spark), tables), [x for x in rows if x[0] in (2, 7)]),
            (transactions.orphans(log(spark), tables), [x for x in rows if x[0] not in (2, 7)]),
            (catalog.with_relation(log(spark), relations), rows),
            (replay.after_truncate(log(spark), bases.select("relation_oid", F.col("start_lsn").alias("pos")).where("pos is not null"), ["pos"]), [x for x in rows if x[1] > low.get(x[0], -1)]),
        ):
            assert not re.search(r"hashpartitioning\(relation_oid#\d+L?, \d+\)", plan(found))
            assert sorted((r.relation_oid, r.final_lsn) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_literals_reach_the_scan(spark, tmp_path):
    log(spark).write.parquet(str(tmp_path / "log"))
    found = transactions.tracked(spark.read.parquet(str(tmp_path / "log")), spark.createDataFrame([(7,), (2,)], "relation_oid long"))
    assert re.search(r"PushedFilters: \[.*In\(relation_oid, \[.*7.*\]", plan(found))


def test_only_repeated_transactions_are_compared(spark):
    """Deliveries of a transaction hold ranges of numbers; a payload is in no aggregate and no shuffle."""
    def delivery(oid, lsn, tx_pos, upto):
        return [(oid, lsn, seq, tx_pos + seq, tx_pos, f"payload {oid} {lsn} {seq}") for seq in range(1, upto + 1)]

    rows = delivery(1, 10, 100, 5) + delivery(1, 20, 200, 3) + delivery(2, 10, 300, 4)
    # The open transaction comes again and goes further, then once more in part.
    again = delivery(1, 20, 400, 6) + delivery(1, 20, 500, 2)
    none = [(1, None, None, 1, None, "before any begin")] * 2
    changes = spark.createDataFrame(rows + again + none, "relation_oid long, final_lsn long, seq int, pos long, tx_pos long, payload string")
    found = transactions.dedupe(changes)
    got = sorted((r.relation_oid, r.final_lsn or 0, r.seq or 0, r.pos) for r in found.collect())
    want = [(1, 10, s, 100 + s) for s in range(1, 6)] + [(1, 20, s, 200 + s) for s in range(1, 4)] + [(1, 20, s, 400 + s) for s in range(4, 7)]
    assert got == sorted(want + [(2, 10, s, 300 + s) for s in range(1, 5)] + [(1, 0, 0, 1)] * 2)
    assert not re.search(r"(Aggregate|Exchange)[^\n]*payload", plan(found))
    once = spark.createDataFrame(rows, changes.schema)
    assert transactions.dedupe(once) is once


def test_a_large_side_is_neither_broadcast_nor_copied_for_every_key(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST", 0)
    monkeypatch.setattr(lookup, "HOT_ROWS", 500)
    rows = log(spark).unionByName(log(spark).limit(40).withColumn("relation_oid", F.lit(None).cast("bigint")))
    small = spark.createDataFrame([(i, f"t{i}") for i in range(2, 20)], "relation_oid long, name string")
    names = {i: f"t{i}" for i in range(2, 20)}
    want = [(r.relation_oid, r.final_lsn, names.get(r.relation_oid)) for r in rows.collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    for how, kept in (("left", want), ("left_semi", [x for x in want if x[2]]), ("left_anti", [x for x in want if not x[2]])):
        found = lookup.join_small(rows, small, ["relation_oid"], how)
        got = [(r.relation_oid, r.final_lsn, names.get(r.relation_oid)) for r in found.collect()]
        assert sorted(got, key=key) == sorted(kept, key=key)
        assert "SortMergeJoin" in plan(found) and found.columns[: len(rows.columns)] == rows.columns
    assert lookup.join_small(rows, small, ["relation_oid"]).columns == [*rows.columns, "name"]
