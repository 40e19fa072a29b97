"""Blocked scans against plain loops, with blocks small enough to cross many borders."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators.scan import Last, Prev, RowNumber, RunningMax, RunningSum, asof_join, ordered_scan


def _rows(seed, n=400, hot=0.6):
    rng = random.Random(seed)
    positions = rng.sample(range(3000), n)
    return [
        ("hot" if rng.random() < hot else rng.choice("xyz"), p, rng.choice([None, None, rng.randint(-50, 50)]))
        for p in positions
    ]


@pytest.mark.parametrize("bits,levels", [(3, 1), (3, 2), (4, 3), (20, 1)])
def test_running_values(spark, bits, levels):
    rows = _rows(bits * 10 + levels)
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    specs = [
        Last("last_v", F.col("v")),
        Prev("prev_v", F.col("v")),
        RowNumber("n"),
        RunningSum("total", F.col("v")),
        RunningMax("top", F.col("v")),
    ]
    got = {
        (r.k, r.pos): (r.last_v, r.prev_v, r.n, r.total, r.top)
        for r in ordered_scan(df, ["k"], ["pos"], specs, bits=bits, levels=levels).collect()
    }
    want, state = {}, {}
    for k, pos, v in sorted(rows, key=lambda r: r[1]):
        last, n, total, top = state.get(k, (None, 0, None, None))
        prev = last
        n += 1
        if v is not None:
            last = v
            total = v if total is None else total + v
            top = v if top is None else max(top, v)
        state[k] = (last, n, total, top)
        want[k, pos] = (last, prev, n, total, top)
    assert got == want


def test_two_part_order_and_no_keys(spark):
    rng = random.Random(5)
    rows = [(tx, p, rng.choice([None, p])) for tx in range(6) for p in rng.sample(range(500), 40)]
    df = spark.createDataFrame(rows, "tx bigint, pos bigint, v bigint")
    out = ordered_scan(df, [], ["tx", "pos"], [RowNumber("n"), Prev("p", F.col("v"))], bits=4, levels=2).collect()
    want, last = {}, None
    for n, (tx, pos, v) in enumerate(sorted(rows, key=lambda r: r[:2]), 1):
        want[tx, pos] = (n, last)
        last = last if v is None else v
    assert {(r.tx, r.pos): (r.n, r.p) for r in out} == want


def test_asof_join(spark):
    rng = random.Random(9)
    marks = [(k, at, f"{k}{at}") for k in "ab" for at in rng.sample(range(1000), 30)]
    asked = [(i, rng.choice("abc"), rng.randrange(1000)) for i in range(300)]
    left = spark.createDataFrame(asked, "id int, k string, at bigint")
    right = spark.createDataFrame(marks, "k string, since bigint, name string")
    got = {r.id: r.name for r in asof_join(left, right, ["k"], "at", "since", ["name"], bits=5).collect()}
    for i, k, at in asked:
        fits = [m for m in marks if m[0] == k and m[1] <= at]
        assert got[i] == (max(fits, key=lambda m: m[1])[2] if fits else None)


def test_a_hot_key_is_spread_over_blocks(spark):
    df = spark.range(0, 4096).select(F.lit(1).alias("k"), F.col("id").alias("pos"))
    out = ordered_scan(df, ["k"], ["pos"], [RowNumber("n")], bits=6)
    assert out.where("n <> pos + 1").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__b0" in plan  # window partitions are (key, block)


def test_a_table_small_only_in_its_files_is_not_broadcast(spark):
    """One block per key: the carried values are as many as the rows, a few bytes each in their files."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400k")
    try:
        rows = spark.range(30_000).selectExpr("id div 2 as k", "id as pos")
        found = ordered_scan(rows, ["k"], ["pos"], [RowNumber("n")], bits=1)
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("n = pos % 2 + 1").count() == 30_000
        few = ordered_scan(rows.where("k < 50"), ["k"], ["pos"], [RowNumber("n")], bits=1)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
