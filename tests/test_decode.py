"""Golden byte vectors and segment files."""

import datetime
import struct

import pytest

from tidelog.plans import jobs
from tidelog.sources.segments import list_segments, read_segments, split_frames, with_header
from tidelog.sources.wire import decode_control, decode_messages

GOLDEN = {
    "begin": "4200000016b374d8480002b0d5d4e940000000004d",
    "commit": "430000000016b374d84800000016b374d8780002b0d5d4e94000",
    "relation": "52000040017075626c69630074657374006400030169640000000017ffffffff0076616c75650000000017ffffffff00686173680000000019ffffffff",
    "insert": "49000040014e0003740000000131740000000234327400000003616263",
    "update": "55000040014e00037400000001316e75",
    "update_key": "55000040014b00037400000001316e6e4e00037400000001327400000002343375",
    "delete": "44000040014b00037400000001326e6e",
    "truncate": "5400000002030000400100004002",
    "origin": "4f00000016b374d848757000",
    "type": "59000040747075626c6963006d6f6f6400",
}
NEW_YEAR = datetime.datetime(2024, 1, 1)


def _decode(spark, vectors, mode="FAILFAST"):
    df = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, h in vectors.items()], "what string, raw binary")
    return {r.what: r for r in decode_messages(df, mode).collect()}


def test_golden_vectors(spark):
    got = _decode(spark, GOLDEN)
    b, c = got["begin"], got["commit"]
    assert (b.msg_type, b.final_lsn, b.commit_ts, b.xid) == ("begin", 97500059720, NEW_YEAR, 77)
    assert (c.flags, c.commit_lsn, c.end_lsn, c.commit_ts) == (0, 97500059720, 97500059768, NEW_YEAR)
    r = got["relation"]
    assert (r.relation_oid, r.namespace, r.name, r.replica_identity) == (16385, "public", "test", "d")
    assert [tuple(x) for x in r.columns] == [(True, "id", 23, -1), (False, "value", 23, -1), (False, "hash", 25, -1)]

    def cells(t):
        return None if t is None else [tuple(x) for x in t]

    assert cells(got["insert"].new_row) == [("t", "1"), ("t", "42"), ("t", "abc")]
    u = got["update"]
    assert u.ident is None and u.ident_is_key is None and cells(u.new_row) == [("t", "1"), ("n", None), ("u", None)]
    u = got["update_key"]
    assert u.ident_is_key and cells(u.ident) == [("t", "1"), ("n", None), ("n", None)]
    assert cells(u.new_row) == [("t", "2"), ("t", "43"), ("u", None)]
    d = got["delete"]
    assert d.ident_is_key and cells(d.ident)[0] == ("t", "2") and d.new_row is None
    t = got["truncate"]
    assert t.cascade and t.restart_identity and t.relation_oids == [16385, 16386]
    assert (got["origin"].origin_lsn, got["origin"].name) == (97500059720, "up")
    assert (got["type"].type_oid, got["type"].namespace, got["type"].name) == (16500, "public", "mood")


def test_every_cut_is_noticed(spark):
    for name in ("insert", "update_key", "delete", "relation", "begin", "commit"):
        whole = GOLDEN[name]
        cuts = {f"{i:04d}": whole[: 2 * i] for i in range(0, len(whole) // 2)}
        got = _decode(spark, cuts, "PERMISSIVE")
        assert all(r._corrupt for r in got.values()), name
        assert len(got) == len(cuts)


def test_unknown_type(spark):
    assert _decode(spark, {"z": "5a00"}, "PERMISSIVE")["z"]._corrupt
    with pytest.raises(Exception, match="unreadable"):
        _decode(spark, {"z": "5a00"})


def test_absurd_counts_are_corrupt_not_allocated(spark):
    assert _decode(spark, {"i": "49000040014effff74"}, "PERMISSIVE")["i"]._corrupt
    assert _decode(spark, {"i": "49000040014e000174ffffffff31"}, "PERMISSIVE")["i"]._corrupt


def test_control_fields_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(bytearray.fromhex(GOLDEN["begin"]),)], "raw binary")
    out = decode_control(df)
    assert out.first().xid == 77
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def _file(lo, hi, t0, t1, frames):
    body = b"".join(struct.pack(">Q", 8 + len(f)) + f for f in frames)
    return struct.pack(">IQQQQI", 0, lo, hi, t0, t1, len(frames)) + body


@pytest.fixture(scope="module")
def segment_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("segments")
    deltas = root / "01" / "40" / "00" / "16385" / "deltas"
    deltas.mkdir(parents=True)
    b, i, c = (bytes.fromhex(GOLDEN[n]) for n in ("begin", "insert", "commit"))
    second = 1704067200
    (deltas / "00000016b374d848").write_bytes(_file(97500059720, 97500059720, second, second, [b, i]))
    (deltas / "00000016b374d848.1").write_bytes(_file(97500059720, 97500059720, second, second, [i]))
    (deltas / "00000016b374d848.10").write_bytes(_file(97500059720, 97500059720, second, second, [c]))
    (root / "state.yaml").write_text("not a segment")
    return root


def test_segment_file_layout(spark):
    golden = (
        "0000000000000016b374d84800000016b374d8480000000065920080000000006592008000000003"
        "000000000000001d4200000016b374d8480002b0d5d4e940000000004d0000000000000025490000"
        "40014e00037400000001317400000002343274000000036162630000000000000022430000000016"
        "b374d84800000016b374d8780002b0d5d4e94000"
    )
    df = spark.createDataFrame([("f", bytearray.fromhex(golden))], "path string, content binary")
    head = with_header(df).first()
    assert (head.min_lsn, head.max_lsn, head.messages, head.min_ts) == (97500059720, 97500059720, 3, NEW_YEAR)
    frames = split_frames(df).orderBy("frame_no").collect()
    assert [bytes(f.raw).hex() for f in frames] == [GOLDEN["begin"], GOLDEN["insert"], GOLDEN["commit"]]


def test_torn_segment(spark):
    whole = _file(1, 1, 0, 0, [bytes.fromhex(GOLDEN["insert"])] * 3)
    df = spark.createDataFrame([("f", bytearray(whole[:-5]))], "path string, content binary")
    with pytest.raises(Exception, match="torn frame"):
        split_frames(df).collect()
    frames = split_frames(df, mode="PERMISSIVE").orderBy("frame_no").collect()
    assert len(frames) == 3
    assert [r._corrupt for r in decode_messages(spark.createDataFrame([(bytes(f.raw),) for f in frames[2:]], "raw binary"), "PERMISSIVE").collect()] == [True]


def test_many_frames_cross_batches(spark):
    frame = bytes.fromhex(GOLDEN["update"])
    df = spark.createDataFrame([("f", bytearray(_file(1, 1, 0, 0, [frame] * 9001)))], "path string, content binary")
    out = split_frames(df)
    assert out.count() == 9001 and out.selectExpr("max(frame_no)").first()[0] == 9000


def test_listing_and_order(spark, segment_dir):
    listed = list_segments(spark, str(segment_dir)).collect()
    assert sorted((r.relation_oid, r.min_lsn, r.postfix) for r in listed) == [
        (16385, 97500059720, 0),
        (16385, 97500059720, 1),
        (16385, 97500059720, 10),
    ]
    rows = read_segments(spark, str(segment_dir)).orderBy("pos").collect()
    assert [bytes(r.raw)[:1] for r in rows] == [b"B", b"I", b"I", b"C"]


def test_read_log_and_inspect(spark, segment_dir):
    log = jobs.read_log(spark, str(segment_dir)).orderBy("pos").collect()
    assert [(r.msg_type, r.final_lsn, r.seq, r.relation_oid) for r in log] == [
        ("begin", 97500059720, 1, 16385),
        ("insert", 97500059720, 2, 16385),
        ("insert", 97500059720, 3, 16385),
        ("commit", 97500059720, 4, 16385),
    ]
    lines = [r.line for r in jobs.inspect(spark, str(segment_dir)).orderBy("pos").collect()]
    assert lines[0] == "begin:     FinalLSN:16/B374D848 Timestamp:2024-01-01T00:00:00Z XID:77"
    assert lines[1] == "insert:    relOID:16385 newValues: ['1', '42', 'abc']"
    assert lines[3] == "commit:    LSN:16/B374D848 Timestamp:2024-01-01T00:00:00Z TxEndLSN:16/B374D878"
