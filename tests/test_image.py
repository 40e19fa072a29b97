"""The maintained image: the table's rows at every batch, and only the buckets a batch touches are rewritten."""

import sys
import threading

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  loads the queries in their order
import sequential
from test_archive import OID, dml, frame, message, table, transactions_of, T0
from tidelog.sources import commits
from tidelog.streaming import image
from tidelog.streaming import ingest as ing


def paths(spark, root):
    return {r.path for r in commits.live_segments(spark, f"{root}/image/{OID}").select("path").collect()}


def test_image_follows_the_log(spark, tmp_path):
    root = str(tmp_path / "archive")
    log = sequential.random_log(12, 60)
    messages = transactions_of(log)
    hook = image.keep(root, buckets=8)
    for batch, at in enumerate(range(0, len(messages), 23)):
        ing.store_batch(frame(spark, messages[at : at + 23]), batch, root, after_store=hook)
        done = image.position(spark, root, OID) or 0
        got = image.read_image(spark, root, OID)
        assert ({} if got is None else table(got)) == sequential.apply(log[: done // 1000 * 5])[0]
    assert done == 12000


def test_a_small_batch_rewrites_few_buckets(spark, tmp_path):
    root = str(tmp_path / "archive")
    log = [(i, "I", i, None, {"a": ("t", f"a{i}"), "b": ("t", "b")}) for i in range(200)]
    ing.store_batch(frame(spark, transactions_of(log)), 0, root)
    assert image.advance(spark, root, OID, buckets=16) == 16
    before = paths(spark, root)
    assert len(before) == 16
    ts = T0
    # One row changes, one moves to another key.
    tail = [
        message(90010, "begin", xid=90, final_lsn=90000, commit_ts=ts),
        message(90020, "update", new_row=[("t", "7"), ("t", "new"), ("u", None)]),
        dml(90030, "U", 5000, 9, {"a": ("u", None), "b": ("t", "moved")}),
        message(90040, "commit", commit_lsn=90000, end_lsn=90001, flags=0, commit_ts=ts),
    ]
    ing.store_batch(frame(spark, tail), 1, root)
    assert 1 <= image.advance(spark, root, OID, buckets=16) <= 3
    assert len(before - paths(spark, root)) <= 3
    rows = table(image.read_image(spark, root, OID))
    assert rows[7] == {"a": "new", "b": "b"} and rows[5000] == {"a": "a9", "b": "moved"} and 9 not in rows and len(rows) == 200
    assert image.advance(spark, root, OID, buckets=16) == 0


def test_a_truncate_empties_the_image(spark, tmp_path):
    root = str(tmp_path / "archive")
    ing.store_batch(frame(spark, transactions_of(sequential.random_log(4, 10))), 0, root)
    image.advance(spark, root, OID, buckets=4)
    tail = [
        message(5000, "begin", xid=90, final_lsn=90000, commit_ts=T0),
        {**message(5010, "truncate", relation_oids=[OID], cascade=False, restart_identity=False), "relation_oid": None},
        dml(5020, "I", 500, None, {"a": ("t", "new"), "b": ("n", None)}),
        message(5030, "commit", commit_lsn=90000, end_lsn=90001, flags=0, commit_ts=T0),
    ]
    ing.store_batch(frame(spark, tail), 1, root)
    image.advance(spark, root, OID, buckets=4)
    assert table(image.read_image(spark, root, OID)) == {500: {"a": "new", "b": None}}


def test_landed_files_follow_the_log_and_split(spark, tmp_path, monkeypatch):
    job_queries = sys.modules["tidelog.fixtures.job_queries"]
    monkeypatch.setattr(job_queries, "ROW_GROUP", 1 << 10)
    log = spark.range(60_000).select(F.lit(1).alias("relation_oid"), F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    job_queries.land(spark, log.orderBy(F.desc("pos")), str(tmp_path / "in"), 3)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len({f.stat().st_mtime_ns // 1_000_000 for f in files}) == 3
    seen = [pq.read_table(f, columns=["pos"]).column(0).to_pylist() for f in files]
    assert [(min(s), max(s), len(s)) for s in seen] == [(k * 20_000, k * 20_000 + 19_999, 20_000) for k in range(3)]
    assert all(pq.ParquetFile(f).num_row_groups > 1 for f in files)


def test_tables_of_a_batch_are_brought_forward_side_by_side(spark, monkeypatch):
    met, done = threading.Barrier(2, timeout=20), []
    live = spark.createDataFrame([(1, 0), (2, 0), (0, 0), (3, -1)], "relation_oid long, batch_id long")
    monkeypatch.setattr(image.commits, "live_segments", lambda *_: live)
    monkeypatch.setattr(image, "advance", lambda spark, root, oid, buckets: (met.wait(), done.append(oid)))
    image.keep("nowhere")(spark, 0)
    assert sorted(done) == [1, 2]
    monkeypatch.setattr(image, "advance", lambda *_: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        image.keep("nowhere")(spark, 0)
