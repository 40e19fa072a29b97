"""The commit log: what readers see between a write and its commit, and how much they open."""

import pytest
from pyspark.sql import functions as F

from tidelog.plans import jobs
from tidelog.sources import commits, store
from tidelog.streaming import ingest as ing

import sequential
from test_archive import OID, frame, names, table, transactions_of


def entries(spark, *rows):
    """Manifest rows (path, batch, low, high)."""
    made = spark.createDataFrame(rows, "path string, batch_id long, min_lsn long, max_lsn long")
    return made.withColumns({"relation_oid": F.lit(OID).cast("bigint"), "segment_id": F.col("batch_id"), "messages": F.lit(1).cast("bigint")})


def live(spark, root, version=None):
    return sorted(r.path for r in commits.live_segments(spark, root, version).collect())


def test_a_long_log_opens_no_more_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "EVERY", 5)
    root, opened = str(tmp_path), []
    for n in range(1, 24):
        removed = spark.createDataFrame([(f"p{n - 2}",)], "path string") if n % 4 == 0 else None
        assert commits.commit(spark, root, "batch", entries(spark, (f"p{n}", n, n, n)), removed, (n, f"s{n}")) == n
        opened.append(len(commits.opened_paths(commits._since(spark, root, n))))
    want = {f"p{n}" for n in range(1, 24)} - {f"p{n - 2}" for n in range(4, 24, 4)}
    assert live(spark, root) == sorted(want)
    assert max(opened[15:]) <= max(opened[:10]) <= 2 * 5
    assert live(spark, root, 3) == ["p1", "p2", "p3"]
    assert commits.ingest_state(spark, root) == "s23"
    assert commits.ingest_state(spark, root, 23) == "s22"
    with pytest.raises(ValueError, match="long ago"):
        commits.ingest_state(spark, root, 10)


def test_a_version_is_taken_once(spark, tmp_path):
    root = str(tmp_path)
    commits.commit(spark, root, "batch", entries(spark, ("p1", 1, 1, 1)))
    assert commits._publish(spark, commits._name(root, 1), "{}") is False
    assert live(spark, root) == ["p1"]
    gone = spark.createDataFrame([("p1",)], "path string")
    commits.commit(spark, root, "merge", entries(spark, ("p2", 1, 1, 1)), gone)
    # A second merge of the same directory would double its rows.
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, "merge", entries(spark, ("p3", 1, 1, 1)), gone)
    assert live(spark, root) == ["p2"]


def test_a_reader_during_a_retry_sees_the_whole_batch(spark, tmp_path):
    root = str(tmp_path / "archive")
    messages = transactions_of(sequential.random_log(5, 20, moves=False))
    ing.store_batch(frame(spark, messages), 0, root)
    reader = store.read_changes(spark, root)
    # What an attempt has written counts only with its commit.
    frame(spark, messages[:3]).write.partitionBy("relation_oid").parquet(f"{root}/changes/batch_id=0/attempt=abroken")
    assert store.read_changes(spark, root).count() == len(messages)
    ing.store_batch(frame(spark, messages), 0, root)
    assert store.read_changes(spark, root).count() == reader.count() == len(messages)


def test_only_what_a_restore_needs_is_opened(spark, tmp_path):
    root = str(tmp_path / "archive")
    messages = transactions_of(sequential.random_log(6, 60, moves=False))
    for batch, at in enumerate(range(0, len(messages), 10)):
        ing.store_batch(frame(spark, messages[at : at + 10]), batch, root, messages_per_segment=5)
    every = store.read_changes(spark, root, OID).inputFiles()
    some = store.read_changes(spark, root, OID, after_lsn=10000, upto_lsn=11000).inputFiles()
    assert 0 < len(some) < len(every) / 2


def test_merged_batches_restore_alike(spark, tmp_path):
    root = str(tmp_path / "archive")
    log = sequential.random_log(8, 80, moves=False)
    messages = transactions_of(log)
    names(spark, root)
    cuts = range(0, len(messages), 9)
    for batch, at in enumerate(cuts):
        ing.store_batch(frame(spark, messages[at : at + 9]), batch, root, messages_per_segment=4)
    before = store.read_segment_manifest(spark, root)
    stats = ["relation_oid", "segment_id", "min_lsn", "max_lsn", "messages"]
    kept = sorted(map(tuple, before.select(stats).collect()))
    want = {lsn: sequential.apply(log[: lsn // 1000 * 5])[0] for lsn in (4000, 16000)}
    paths = before.select("path").distinct().count()
    assert store.merge_batches(spark, root, fan=3) == len(cuts) - 1
    after = store.read_segment_manifest(spark, root)
    assert sorted(map(tuple, after.select(stats).collect())) == kept
    assert after.select("path").distinct().count() == 2 < paths
    for lsn, rows in want.items():
        assert table(jobs.restore(spark, root, "public", "test", at_lsn=lsn)) == rows
    # The newest batch may come again; it is not merged.
    last = list(cuts)[-1]
    ing.store_batch(frame(spark, messages[last:]), len(cuts) - 1, root, messages_per_segment=4)
    assert store.read_changes(spark, root).count() == len(messages)
    jobs.compact(spark, root, OID, 16000)
    gone = jobs.purge(spark, root, dry_run=False)
    assert gone.count() >= 1
    assert table(jobs.restore(spark, root, "public", "test", at_lsn=16000)) == want[16000]


def test_batch_numbers_leave_positions_alone(spark, tmp_path):
    """Positions and segments are counted, so batch numbers may be as large as they like."""
    root = str(tmp_path / "archive")
    log = sequential.random_log(9, 40, moves=False)
    messages = transactions_of(log)
    for batch, at in ((1 << 40, 0), ((1 << 40) + 1, 25)):
        ing.store_batch(frame(spark, messages[at : at + 25 if at == 0 else None]), batch, root, messages_per_segment=7)
    manifest = store.read_segment_manifest(spark, root).orderBy("segment_id").collect()
    assert [r.segment_id for r in manifest] == list(range(len(manifest)))
    assert table(jobs.restore_table(spark, root, OID).rows) == sequential.apply(log)[0]
