"""Segment files by byte range: pieces of a file, positions in a stream, and files written from a log."""

import struct

import pytest
from pyspark.sql import functions as F

from tidelog.sources import segments
from tidelog.streaming import ingest as ing

OID = 16385


def put(folder, name, frames):
    folder.mkdir(parents=True, exist_ok=True)
    body = b"".join(struct.pack(">Q", 8 + len(f)) + f for f in frames)
    (folder / name).write_bytes(struct.pack(">IQQQQI", 0, 1, 2, 3, 4, len(frames)) + body)
    return 40 + len(body)


def test_a_long_file_is_read_in_pieces(spark, tmp_path, monkeypatch):
    frames = [bytes([65 + i % 26]) * (1 + 37 * i % 300) for i in range(2000)]
    put(tmp_path / str(OID), f"{5:016x}", frames)
    put(tmp_path / str(OID), f"{6:016x}", frames[:3])
    monkeypatch.setattr(segments, "_CHUNK", 777)
    rows = segments.read_segments(spark, str(tmp_path), split_bytes=20_000)
    found = rows.orderBy("pos").collect()
    assert [bytes(r.raw) for r in found] == frames + frames[:3]
    assert [r.frame_no for r in found] == [*range(2000), 0, 1, 2]
    # A position is a byte of the stream.
    assert [r.pos for r in found[:2]] == [40, 40 + 8 + len(frames[0])]
    large = segments.list_segments(spark, str(tmp_path)).where("length > 20000")
    cuts = segments.frame_index(large, 20_000).orderBy("first").collect()
    assert len(cuts) > 10 and cuts[0]["first"] == 40 and all(a["last"] == b["first"] for a, b in zip(cuts, cuts[1:]))
    assert all(c["last"] - c["first"] < 20_000 + 400 for c in cuts)
    assert rows.rdd.getNumPartitions() > 10
    # Contents never ride through a join or a shuffle.
    assert "content" not in rows._jdf.queryExecution().executedPlan().toString()


def test_torn_file(spark, tmp_path):
    size = put(tmp_path / str(OID), f"{5:016x}", [b"Aaaa", b"Bbbb", b"Cccc"])
    path = tmp_path / str(OID) / f"{5:016x}"
    path.write_bytes(path.read_bytes()[: size - 2])
    with pytest.raises(Exception, match="torn frame"):
        segments.read_segments(spark, str(tmp_path)).collect()
    found = segments.read_segments(spark, str(tmp_path), mode="PERMISSIVE").orderBy("pos").collect()
    assert [bytes(r.raw) for r in found[:2]] == [b"Aaaa", b"Bbbb"] and bytes(found[2].raw)[:8] == struct.pack(">Q", 12)


def test_positions_go_on_from_batch_to_batch(spark, tmp_path):
    """A stream of any length: positions are bytes, so neither batches nor frames are packed into them."""
    size = put(tmp_path / str(OID), f"{5:016x}", [b"B" + struct.pack(">QqI", 5, 0, 1), b"C" + struct.pack(">BQQq", 0, 5, 6, 0)])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "length")
    far = (1 << 40) * (1 << 20)
    state = spark.createDataFrame([(OID, None, None, None, None, None, far, 7)], ing.STATE)
    changes, after = ing.decode_batch(files, state)
    assert [r.pos for r in changes.orderBy("pos").collect()] == [far + 40, far + 40 + 8 + 21]
    assert after.first().next_pos == far + size


def test_written_files_are_the_messages(spark, tmp_path):
    rows = [(OID + i % 2, i // 6, i, bytearray(b"I" + bytes([i])), 100 + 10 * (i // 12), None) for i in range(60)]
    log = spark.createDataFrame(rows, "relation_oid long, segment_id long, pos long, raw binary, final_lsn long, commit_ts timestamp").repartition(5)
    written = segments.write_segment_files(log, str(tmp_path)).collect()
    assert sum(r.messages for r in written) == 60
    read = segments.read_segments(spark, str(tmp_path))
    for oid in (OID, OID + 1):
        got = [bytes(r.raw) for r in read.where(F.col("relation_oid") == oid).orderBy("pos").collect()]
        assert got == [bytes(r[3]) for r in rows if r[0] == oid]
    heads = segments.read_headers(segments.list_segments(spark, str(tmp_path)))
    assert {(r.segment_name, r.messages) for r in heads.collect()} == {(r.segment_name, r.messages) for r in written}


def test_data_source_reads_pieces_and_streams_by_file_and_byte(spark, tmp_path):
    from tidelog.sources import datasource

    datasource.register(spark)
    root, first = tmp_path / "in", [bytes([65 + i % 26]) * (1 + 37 * i % 300) for i in range(500)]
    put(root / str(OID), f"{5:016x}", first)
    put(root / str(OID + 1), f"{5:016x}", first[:3])
    index = datasource.write_frame_index(spark, str(root), str(tmp_path / "index"), 10_000)
    batch = spark.read.format("tidelog_segments").option("index", index).load(str(root))
    assert batch.rdd.getNumPartitions() > 5
    found = batch.where(F.col("relation_oid") == OID).orderBy("pos").collect()
    assert [bytes(r.raw) for r in found] == first and [r.frame_no for r in found] == list(range(500))

    def run():
        stream = spark.readStream.format("tidelog_segments").load(str(root))
        writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run().count() == 503
    # Later files by name, whatever their time; positions go on where the stream ended.
    put(root / str(OID), f"{5:016x}.10", [b"z"])
    put(root / str(OID), f"{5:016x}.2", [b"y"])
    rows = run().where(F.col("relation_oid") == OID).orderBy("pos").collect()
    assert [bytes(r.raw) for r in rows] == [*first, b"y", b"z"]
    assert run().count() == 505


def test_small_segments_share_batches(spark):
    """Three frames per segment, the last one torn in every other: one batch for many segments."""
    frame = lambda raw: struct.pack(">Q", 8 + len(raw)) + raw
    rows = [(i, bytearray(bytes(40) + frame(b"Ia") + frame(b"") + frame(b"Ic")[: 10 - i % 2])) for i in range(600)]
    made = segments.split_frames(spark.createDataFrame(rows, "id long, content binary").coalesce(1), mode="PERMISSIVE")
    found = {(r.id, r.frame_no): bytes(r.raw) for r in made.collect()}
    assert found == {
        (i, n): raw for i in range(600) for n, raw in enumerate([b"Ia", b"", frame(b"Ic")[:9] if i % 2 else b"Ic"])
    }
    assert made.mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), made.schema).count() < 20
    with pytest.raises(Exception, match="torn frame 2"):
        segments.split_frames(spark.createDataFrame(rows[1:2], "id long, content binary")).collect()


def test_a_segment_is_written_by_one_task_however_the_join_runs(spark, tmp_path):
    """A merge join that turns into a broadcast while it runs must not part a segment's messages."""
    made = spark.range(0, 30_000, 1, 7).select(
        F.lit(OID).cast("bigint").alias("relation_oid"), (F.col("id") % 3000).alias("segment_id"), F.col("id").alias("pos"),
        F.encode(F.concat(F.lit("I"), F.col("id").cast("string")), "UTF-8").alias("raw"), (F.col("id") % 3000).alias("final_lsn"),
        F.lit(None).cast("timestamp").alias("commit_ts"),
    )
    made.write.parquet(str(tmp_path / "log"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        root = str(tmp_path / "out")
        assert segments.write_segment_files(spark.read.parquet(str(tmp_path / "log")), root).count() == 3000
        frames = segments.read_segments(spark, root).groupBy("segment_name").agg(F.count("*").alias("n"))
        assert frames.where("n = 10").count() == 3000
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_small_files_share_a_task():
    from tidelog.sources import datasource

    def piece(n, first, last, size):
        return datasource.Piece(datasource.Segment(OID, n, 0, f"/x/{OID}/{n:016x}", size), 0, first, last, 0)

    small = [piece(n, 40, 140, 140) for n in range(600)]
    cut = [piece(600, a, a + 1000, 3040) for a in (40, 1040, 2040)]
    packed = datasource._packed([*small, *cut])
    assert [len(p.held) for p in packed] == [256, 256, 88, 1, 1, 1]
    assert [q for p in packed for q in p.held] == [*small, *cut]


def test_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The plan of a listing names no files: their number does not reach the driver."""
    import pyarrow as pa

    from tidelog.sources import files as listing

    root = tmp_path / "in"
    sizes = {}
    for oid in (OID, OID + 1, OID + 2):
        for i in range(40):
            name = f"{i // 2 + 1:016x}" + (".1" if i % 2 else "")
            sizes[oid, i // 2 + 1, i % 2] = put(root / f"{oid & 255:02x}" / "40" / "00" / str(oid) / "deltas", name, [b"Ba"] * (1 + i))
    # A task that saw many entries leaves the other folders to the next round.
    monkeypatch.setattr(listing, "FOLDER_ENTRIES", 20)
    deltas = [f"{root}/{n:02x}/40/00/{OID - 1 + n}/deltas" for n in (1, 2, 3)]
    rows = [r for b in listing._list(iter([pa.RecordBatch.from_arrays([pa.array([deltas[0], str(root)])], ["path"])])) for r in b.to_pylist()]
    left = {r["path"] for r in rows if r["folder"]}
    assert len([r for r in rows if not r["folder"]]) == 80 and len(left) == 2 and left < set(deltas)
    # Left out as before: hidden files and folders, empty files, files that lie elsewhere.
    put(root / ".draft" / str(OID), f"{9:016x}", [b"B"])
    put(root / "_old" / str(OID), f"{9:016x}", [b"B"])
    (root / "01" / "40" / "00" / str(OID) / "deltas" / f".{1:016x}.crc").write_bytes(b"crc")
    (root / "01" / "40" / "00" / str(OID) / "deltas" / f"{77:016x}").write_bytes(b"")
    (root / "state").mkdir()
    (root / "state" / "notes.txt").write_bytes(b"x")
    found = segments.list_segments(spark, str(root))
    assert {(r.relation_oid, r.min_lsn, r.postfix): r.length for r in found.collect()} == sizes and found.count() == 120
    assert len(found.inputFiles()) < 30 and found.rdd.getNumPartitions() == 2
    # One file, folders by a wildcard, and the path as Spark names it.
    one = segments.list_segments(spark, str(root / "01" / "40" / "00" / str(OID) / "deltas" / f"{3:016x}.1"))
    before = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "length")
    assert [(r.path, r.length) for r in one.collect()] == [(r.path, r.length) for r in before.where(f"path like '%/{OID}/deltas/{3:016x}.1'").collect()]
    assert segments.list_segments(spark, str(root / "0[12]")).count() == 80
    assert segments.list_segments(spark, str(root / "state")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        segments.list_segments(spark, str(root / "none"))
