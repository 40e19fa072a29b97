"""Replay against the sequential replayer, golden histories, and multisets."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import sequential
from tidelog.operators import replay, transactions

SCHEMA = "pos bigint, op string, k int, old_k int, a string, a__kind string, b string, b__kind string"


def frame(spark, log):
    rows = [(pos, op, k, old, c["a"][1], c["a"][0], c["b"][1], c["b"][0]) for pos, op, k, old, c in log]
    return spark.createDataFrame(rows, SCHEMA)


def result(df):
    rows = df.collect()
    out = {r.k: {"a": r.a, "b": r.b} for r in rows}
    assert len(out) == len(rows), "a key came out twice"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_keyed_replay(spark, seed):
    log = sequential.random_log(seed, 400, moves=False)
    want, _ = sequential.apply(log)
    shuffled = random.Random(seed).sample(log, len(log))
    assert result(replay.replay(frame(spark, shuffled), ["k"], ["a", "b"], ["pos"], by=[])) == want


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_replay_with_moves(spark, seed):
    log = sequential.random_log(seed, 250, moves=True)
    assert sum(c[3] is not None for c in log) > 20
    want, _ = sequential.apply(log)
    got = replay.replay(frame(spark, log), ["k"], ["a", "b"], ["pos"], by=[], bits=3)
    assert result(got) == want


def test_base_and_tail_equal_the_whole_log(spark):
    log = sequential.random_log(8, 300, moves=True)
    want, _ = sequential.apply(log)
    for cut in (1, 60, 299):
        head, _ = sequential.apply([c for c in log if c[0] <= cut])
        rows = [(k, r["a"], r["b"]) for k, r in head.items()]
        base = spark.createDataFrame(rows, "k int, a string, b string").withColumn("start_lsn", F.lit(cut).cast("bigint"))
        tail = frame(spark, [c for c in log if c[0] > cut]).withColumnRenamed("pos", "lsn")
        both = replay.base_plus_tail(base, tail, ["k"], ["a", "b"], ["lsn"])
        assert result(replay.replay(both, ["k"], ["a", "b"], ["lsn"], by=[])) == want


def test_long_chain_takes_few_rounds(spark):
    n = 300
    log = [(1, "I", 0, None, {"a": ("t", "first"), "b": ("t", "kept")})]
    log += [(i + 1, "U", i, i - 1, {"a": ("u", None), "b": ("u", None)}) for i in range(1, n)]
    got = result(replay.replay(frame(spark, log), ["k"], ["a", "b"], ["pos"], by=[]))
    assert got == {n - 1: {"a": "first", "b": "kept"}}


def test_stale_cell_of_an_earlier_life_does_not_return(spark):
    log = [
        (10, "I", 1, None, {"a": ("t", "1"), "b": ("t", "a")}),
        (11, "I", 2, None, {"a": ("t", "1"), "b": ("t", "b")}),
        (20, "D", 2, None, {"a": (None, None), "b": (None, None)}),
        (30, "U", 2, 1, {"a": ("u", None), "b": ("u", None)}),
    ]
    assert result(replay.replay(frame(spark, log), ["k"], ["a", "b"], ["pos"], by=[])) == {2: {"a": "1", "b": "a"}}


def test_move_of_a_missing_row_has_no_effect(spark):
    cells = {"a": ("t", "x"), "b": ("u", None)}
    log = [(1, "U", 2, 1, cells), (2, "U", 3, 2, cells), (3, "I", 9, None, {"a": ("t", "y"), "b": ("n", None)})]
    assert result(replay.replay(frame(spark, log), ["k"], ["a", "b"], ["pos"], by=[])) == {9: {"a": "y", "b": None}}


def test_change_of_the_old_key_after_the_move_is_ignored(spark):
    log = [
        (1, "I", 1, None, {"a": ("t", "1"), "b": ("t", "1")}),
        (2, "U", 2, 1, {"a": ("u", None), "b": ("u", None)}),
        (3, "U", 1, None, {"a": ("t", "wrong"), "b": ("t", "wrong")}),
    ]
    assert result(replay.replay(frame(spark, log), ["k"], ["a", "b"], ["pos"], by=[])) == {2: {"a": "1", "b": "1"}}


def test_update_without_a_row(spark):
    log = [(10, "U", 7, None, {"a": ("t", "1"), "b": ("t", "1")})]
    df = frame(spark, log)
    assert result(replay.replay(df, ["k"], ["a", "b"], ["pos"], by=[])) == {}
    found = replay.replay_anomalies(df, ["k"], ["pos"]).collect()
    assert [(r.k, r.anomaly, r.changes) for r in found] == [(7, "update_of_missing_row", 1)]


def test_anomalies(spark):
    none = {"a": (None, None), "b": (None, None)}
    sent = {"a": ("t", "1"), "b": ("t", "1")}
    log = [(1, "I", 1, None, sent), (2, "I", 1, None, sent), (3, "D", 1, None, none), (4, "D", 1, None, none)]
    found = {(r.k, r.anomaly): r.changes for r in replay.replay_anomalies(frame(spark, log), ["k"], ["pos"]).collect()}
    assert found == {(1, "insert_on_live_key"): 1, (1, "delete_of_missing_row"): 1}


def test_golden_history_with_a_base(spark):
    """Late, superseded, moved, null, unchanged, uncommitted and redelivered changes."""
    n, u = ("n", None), ("u", None)

    def t(v):
        return ("t", v)

    base = spark.createDataFrame([(1, "10", "aa"), (2, "20", "bb"), (3, "30", "cc")], "k int, a string, b string")
    base = base.withColumn("start_lsn", F.lit(100).cast("bigint"))
    empty = {"a": (None, None), "b": (None, None)}
    history = [
        (90, 1, "U", 1, None, {"a": t("99"), "b": u}),
        (100, 1, "I", 9, None, {"a": t("9"), "b": t("x")}),
        (110, 1, "U", 1, None, {"a": t("11"), "b": u}),
        (110, 2, "I", 4, None, {"a": t("40"), "b": t("dd")}),
        (120, 1, "D", 2, None, empty),
        (130, 1, "I", 2, None, {"a": t("21"), "b": t("b2")}),
        (140, 1, "U", 30, 3, {"a": u, "b": u}),
        (150, 1, "U", 4, None, {"a": n, "b": t("d'\\x")}),
        (160, 1, "U", 31, 30, {"a": t("33"), "b": u}),
        (170, 1, "D", 1, None, empty),
        (110, 1, "U", 1, None, {"a": t("11"), "b": u}),
        (110, 2, "I", 4, None, {"a": t("40"), "b": t("dd")}),
    ]
    rows = [
        (5, "row", lsn, i, seq, op, k, old, c["a"][1], c["a"][0], c["b"][1], c["b"][0])
        for i, (lsn, seq, op, k, old, c) in enumerate(history)
    ]
    rows += [(5, "commit", lsn, 100 + lsn, 99, None, None, None, None, None, None, None) for lsn in (90, 100, 110, 120, 130, 140, 150, 160)]
    log = spark.createDataFrame(
        rows,
        "relation_oid bigint, msg_type string, final_lsn bigint, pos bigint, seq int, op string, k int, old_k int, a string, a__kind string, b string, b__kind string",
    )
    log = transactions.dedupe(transactions.committed(log))
    tail = transactions.after_base(log, spark.createDataFrame([(5, 100)], "relation_oid bigint, start_lsn bigint"))
    both = replay.base_plus_tail(base, tail.where("op is not null"), ["k"], ["a", "b"])
    got = result(replay.replay(both, ["k"], ["a", "b"], by=[]))
    assert got == {
        1: {"a": "11", "b": "aa"},
        2: {"a": "21", "b": "b2"},
        4: {"a": None, "b": "d'\\x"},
        31: {"a": "33", "b": "cc"},
    }


def test_truncate_is_a_barrier(spark):
    def cells(v):
        return {"a": ("t", v), "b": ("n", None)}

    log = frame(spark, [(1, "I", 1, None, cells("1")), (2, "I", 3, None, cells("3")), (4, "I", 5, None, cells("5")), (5, "U", 3, None, cells("x"))])
    log = log.withColumn("relation_oid", F.lit(1))
    cut = spark.createDataFrame([(1, 3), (1, 2)], "relation_oid int, pos bigint")
    kept = replay.after_truncate(log, cut, ["pos"])
    assert result(replay.replay_keyed(kept, ["k"], ["a", "b"], ["pos"])) == {5: {"a": "5", "b": None}}


def test_multiset_replay(spark):
    """{x, x, y}; one x becomes z, y goes, x comes."""
    rows = [("x", 1), ("x", 1), ("y", 1), ("x", -1), ("z", 1), ("y", -1), ("x", 1)]
    signed = spark.createDataFrame(rows, "v string, w bigint")
    assert collections.Counter(r.v for r in replay.replay_full(signed, ["v"]).collect()) == {"x": 2, "z": 1}


def test_copies_are_cut_into_chunks(spark):
    counts = spark.createDataFrame([("hot", 25), ("one", 1), ("bad", -3)], "v string, n bigint")
    out = collections.Counter(r.v for r in replay.expand_copies(counts, chunk=4).collect())
    assert out == {"hot": 25, "one": 1}


def test_full_identity_messages(spark):
    from tidelog.schema import TUPLE
    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("msg_type", T.StringType()), T.StructField("ident", TUPLE), T.StructField("new_row", TUPLE)]
    )
    t, u, n = (lambda v: ("t", v)), ("u", None), ("n", None)
    log = [
        ("insert", None, [t("1"), t("big")]),
        ("insert", None, [t("1"), t("big")]),
        ("update", [t("1"), t("big")], [t("2"), u]),
        ("insert", None, [n, t("x")]),
        ("delete", [n, t("x")], None),
    ]
    columns = [{"name": "a"}, {"name": "b"}]
    signed = replay.signed_rows(spark.createDataFrame(log, schema), columns)
    out = sorted((r.a, r.b) for r in replay.replay_full(signed, ["a", "b"]).collect())
    assert out == [("1", "big"), ("2", "big")]
