"""Ingest, restore, compaction and purge over an archive, against the sequential replayer."""

import datetime
import os
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import sequential
from tidelog.fixtures import tables as t
from tidelog.operators import catalog
from tidelog.plans import jobs
from tidelog.schema import CHANGES
from tidelog.sources import commits, store
from tidelog.streaming import ingest as ing
from tidelog.streaming import live

OID = 16385
T0 = datetime.datetime(2024, 1, 1)
COLUMNS = [(True, "k", 23, -1), (False, "a", 25, -1), (False, "b", 25, -1)]
RELATION = Row(
    relation_oid=OID, lsn=1, namespace="public", name="test", replica_identity="d",
    columns=[Row(is_key=c[0], name=c[1], type_oid=c[2], typmod=c[3]) for c in COLUMNS],
)


def message(pos, msg_type, **fields):
    return {"pos": pos, "msg_type": msg_type, "relation_oid": OID, **fields}


def cell(kind_value):
    return None if kind_value[0] is None else kind_value


def dml(pos, op, k, old, cells):
    key = ("t", str(k))
    if op == "D":
        return message(pos, "delete", ident=[key, ("n", None), ("n", None)], ident_is_key=True)
    row = [key, cells["a"], cells["b"]]
    if op == "I":
        return message(pos, "insert", new_row=row)
    fields = {} if old is None else {"ident": [("t", str(old)), ("n", None), ("n", None)], "ident_is_key": True}
    return message(pos, "update", new_row=row, **fields)


def transactions_of(log, size=5, columns=COLUMNS, first=1):
    """Changes as transactions of ``size``: position 10 per message, commit position 1000 per
    transaction; the relation message comes inside the first one."""
    out, pos = [], first * 10
    for n, at in enumerate(range(0, len(log), size), first):
        lsn, ts = n * 1000, T0 + datetime.timedelta(minutes=n)
        out.append(message(pos := pos + 10, "begin", xid=n, final_lsn=lsn, commit_ts=ts))
        if n == 1:
            out.append(message(pos := pos + 10, "relation", namespace="public", name="test", replica_identity="d", columns=columns))
        for _, op, k, old, cells in log[at : at + size]:
            out.append(dml(pos := pos + 10, op, k, old, cells))
        out.append(message(pos := pos + 10, "commit", commit_lsn=lsn, end_lsn=lsn + 1, flags=0, commit_ts=ts))
    return out


def frame(spark, messages):
    rows = [tuple(m.get(f.name) for f in CHANGES.fields) for m in messages]
    return spark.createDataFrame(rows, CHANGES)


def table(df):
    rows = df.collect()
    out = {r.k: {"a": r.a, "b": r.b} for r in rows}
    assert len(out) == len(rows)
    return out


def names(spark, root):
    history = spark.createDataFrame(
        [(OID, 1, None, "public", "test")], "relation_oid bigint, lsn bigint, next_lsn bigint, namespace string, name string"
    )
    return store.write_name_history(history, root)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "archive")


def prefix(log, lsn, size=5):
    return log[: (lsn // 1000) * size]


def test_batches_with_split_and_redelivered_transactions(spark, root):
    log = sequential.random_log(21, 60)
    messages = transactions_of(log)
    begins = [i for i, m in enumerate(messages) if m["msg_type"] == "begin"]
    cuts = [0, 17, 40, begins[8] + 3, len(messages)]
    top = 100000
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = messages[a:b]
        if batch == 2:
            # The transaction that was open, and the one before it, come again from their begin.
            back = max(i for i in begins if i <= a) if a not in begins else a
            back = begins[begins.index(back) - 1]
            part = [{**m, "pos": m["pos"] + top} for m in messages[back:b]]
        if batch == 3:
            part = [{**m, "pos": m["pos"] + top} for m in part]
        ing.store_batch(frame(spark, part), batch, root, messages_per_segment=7)
        if batch == 1:  # a repeated batch replaces itself
            ing.store_batch(frame(spark, part), batch, root, messages_per_segment=7)
    stored = store.read_changes(spark, root)
    assert stored.count() == len(messages)
    assert stored.select("final_lsn", "seq").distinct().count() == len(messages)
    want, _ = sequential.apply(log)
    assert table(jobs.restore_table(spark, root, OID).rows) == want
    state = ing.read_state(spark, root, 99).first()
    assert (state.committed_lsn, state.open_lsn) == (12000, None)


def test_whole_log_is_routed_to_its_tables(spark, root):
    """Begin and commit of the log reach exactly the tables of the transaction, also when
    batches cut it and when it is delivered again."""
    kv = [(True, "k", 23, -1), (False, "a", 25, -1), (False, "b", 25, -1)]
    logs = {oid: sequential.random_log(oid, 40, moves=False) for oid in (7, 8)}
    feed = {oid: list(log) for oid, log in logs.items()}
    whole, pos, n = [], 0, 0
    while any(feed.values()):
        n += 1
        ts = T0 + datetime.timedelta(minutes=n)
        whole.append({"msg_type": "begin", "xid": n, "final_lsn": n * 1000, "commit_ts": ts})
        for oid in (7, 8):
            if n == 1:
                whole.append({"msg_type": "relation", "relation_oid": oid, "namespace": "public", "name": f"t{oid}", "replica_identity": "d", "columns": kv})
            # Every third transaction touches one table only.
            for _ in range(3 if n % 3 or oid == 7 else 0):
                if feed[oid]:
                    _, op, k, old, cells = feed[oid].pop(0)
                    whole.append({**dml(0, op, k, old, cells), "relation_oid": oid})
        whole.append({"msg_type": "commit", "commit_lsn": n * 1000, "end_lsn": n * 1000 + 1, "flags": 0, "commit_ts": ts})
    whole = [{**m, "pos": i + 1} for i, m in enumerate(whole)]
    begins = [i for i, m in enumerate(whole) if m["msg_type"] == "begin"]
    a, b = begins[4] + 4, begins[9] + 2
    again = [{**m, "pos": m["pos"] + 1000} for m in whole[begins[8] :]]
    for batch, part in enumerate([whole[:a], whole[a:b], again]):
        ing.store_batch(frame(spark, part), batch, root, whole_log=True)
    for oid, log in logs.items():
        assert table(jobs.restore_table(spark, root, oid).rows) == sequential.apply(log)[0]
        mine = store.read_changes(spark, root, oid)
        counts = {r.msg_type: r["count"] for r in mine.groupBy("msg_type").count().collect()}
        assert counts["begin"] == counts["commit"] == mine.select("final_lsn").distinct().count()
        assert sum(counts[k] for k in ("insert", "update", "delete")) == len(log)


def test_a_hole_in_the_log_is_noticed(spark, root):
    messages = transactions_of(sequential.random_log(3, 30, moves=False))
    begins = [i for i, m in enumerate(messages) if m["msg_type"] == "begin"]
    for a, b in ((begins[1], begins[1] + 3), (begins[2] - 2, begins[2] + 3), (begins[1], begins[3] - 1)):
        holed = messages[:a] + messages[b:]
        with pytest.raises(ValueError, match="log order"):
            ing.store_batch(frame(spark, holed), 0, root)
    ing.store_batch(frame(spark, messages[: begins[2] + 2]), 0, root)
    with pytest.raises(ValueError, match="log order"):
        ing.store_batch(frame(spark, messages[begins[3] :]), 1, root)
    ing.store_batch(frame(spark, messages[begins[2] + 2 :]), 1, root)
    assert store.read_changes(spark, root).count() == len(messages)


def test_restore_purge_and_compaction_agree(spark, root):
    log = sequential.random_log(33, 80, moves=False)
    messages = transactions_of(log)
    cuts = [0, 30, 60, 90, len(messages)]
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        ing.store_batch(frame(spark, messages[a:b]), batch, root, messages_per_segment=10)
    assert names(spark, root) is True and names(spark, root) is False

    def restored(lsn):
        return table(jobs.restore(spark, root, "public", "test", at_lsn=lsn))

    wanted = {lsn: sequential.apply(prefix(log, lsn))[0] for lsn in (3000, 8000, 12000, 16000)}
    assert restored(3000) == wanted[3000]
    at = T0 + datetime.timedelta(minutes=8, seconds=30)
    assert table(jobs.restore(spark, root, "public", "test", at_ts=at)) == wanted[8000]

    assert jobs.compact(spark, root, OID, 8500) == 8000
    assert restored(12000) == wanted[12000]
    dry = jobs.purge(spark, root).collect()
    assert [r.batch_id for r in dry] and all(r.max_lsn <= 8000 for r in dry)
    before = store.read_changes(spark, root).count()
    gone = jobs.purge(spark, root, dry_run=False).collect()
    assert {r.batch_id for r in gone} == {r.batch_id for r in dry}
    assert store.read_changes(spark, root).count() < before
    for lsn in (8000, 16000):
        assert restored(lsn) == wanted[lsn]
    assert jobs.purge(spark, root).isEmpty()
    plan = spark.createDataFrame([(OID,), (OID + 1,)], "relation_oid bigint")
    assert jobs.compact_due(spark, root, plan) == {OID: 16000}
    assert store.latest_snapshot(spark, root, OID)["start_lsn"] == 16000
    assert store.latest_snapshot(spark, root, OID, 15999)["start_lsn"] == 8000
    assert table(jobs.restore(spark, root, "public", "test")) == wanted[16000]


def test_restore_refuses_a_different_table(spark, root):
    ing.store_batch(frame(spark, transactions_of(sequential.random_log(1, 10))), 0, root)
    names(spark, root)
    jobs.restore(spark, root, "public", "test", expected=RELATION)
    other = Row(**{**RELATION.asDict(), "columns": RELATION["columns"][:2]})
    with pytest.raises(ValueError, match="tables are different"):
        jobs.restore(spark, root, "public", "test", expected=other)
    with pytest.raises(LookupError, match="no table"):
        jobs.restore(spark, root, "public", "nothing")


def test_open_tail_takes_no_effect(spark, root):
    log = sequential.random_log(2, 20)
    messages = transactions_of(log)
    ing.store_batch(frame(spark, messages[:-1]), 0, root)
    want, _ = sequential.apply(log[:15])
    assert table(jobs.restore_table(spark, root, OID).rows) == want
    state = ing.read_state(spark, root, 1).first()
    assert (state.committed_lsn, state.open_lsn, state.open_xid, state.open_seq) == (3000, 4000, 4, 6)


def test_truncate_in_the_log_and_after_a_snapshot(spark, root):
    log = sequential.random_log(4, 10)
    messages = transactions_of(log)
    ing.store_batch(frame(spark, messages), 0, root)
    jobs.compact(spark, root, OID)
    ts = T0 + datetime.timedelta(hours=1)
    tail = [
        message(5000, "begin", xid=90, final_lsn=90000, commit_ts=ts),
        {**message(5010, "truncate", relation_oids=[OID], cascade=False, restart_identity=False), "relation_oid": None},
        dml(5020, "I", 500, None, {"a": ("t", "new"), "b": ("n", None)}),
        message(5030, "commit", commit_lsn=90000, end_lsn=90001, flags=0, commit_ts=ts),
    ]
    ing.store_batch(frame(spark, tail), 1, root)
    assert table(jobs.restore_table(spark, root, OID).rows) == {500: {"a": "new", "b": None}}
    assert table(jobs.restore_table(spark, root, OID, at_lsn=2000).rows) == sequential.apply(log)[0]


def test_schema_change_in_the_log(spark, root):
    """A column goes, one comes, and a repeated schema message changes nothing."""
    first = [(i, "I", i, None, {"a": ("t", f"a{i}"), "b": ("t", f"b{i}")}) for i in range(5)]
    messages = transactions_of(first)
    ing.store_batch(frame(spark, messages), 0, root)
    newer = [(True, "k", 20, -1), (False, "c", 23, -1), (False, "b", 25, -1)]
    ts = T0 + datetime.timedelta(hours=1)
    schema = {"namespace": "public", "name": "test", "replica_identity": "d", "columns": newer}
    tail = [
        message(5000, "begin", xid=90, final_lsn=90000, commit_ts=ts),
        message(5005, "relation", **schema),
        message(5010, "update", new_row=[("t", "1"), ("t", "7"), ("u", None)]),
        message(5015, "relation", **schema),
        message(5020, "insert", new_row=[("t", "9"), ("n", None), ("t", "z")]),
        message(5030, "commit", commit_lsn=90000, end_lsn=90001, flags=0, commit_ts=ts),
    ]
    ing.store_batch(frame(spark, tail), 1, root)

    def rows():
        out = jobs.restore_table(spark, root, OID)
        assert out.rows.schema.simpleString() == "struct<k:bigint,c:int,b:string>"
        return sorted((r.k, r.c, r.b) for r in out.rows.collect())

    want = [(0, None, "b0"), (1, 7, "b1"), (2, None, "b2"), (3, None, "b3"), (4, None, "b4"), (9, None, "z")]
    assert sorted(rows(), key=str) == sorted(want, key=str)
    jobs.compact(spark, root, OID, 1000)
    assert sorted(rows(), key=str) == sorted(want, key=str)
    before = jobs.restore_table(spark, root, OID, at_lsn=1000).rows
    assert before.columns == ["k", "a", "b"] and before.count() == 5


def test_table_without_a_key(spark, root):
    columns = [(False, "k", 23, -1), (False, "a", 25, -1)]
    x, y, z = ([("t", "1"), ("t", v)] for v in "xyz")
    ts = T0
    messages = [
        message(10, "begin", xid=1, final_lsn=100, commit_ts=ts),
        message(11, "relation", namespace="public", name="test", replica_identity="f", columns=columns),
        message(12, "insert", new_row=x),
        message(13, "insert", new_row=x),
        message(14, "insert", new_row=y),
        message(15, "commit", commit_lsn=100, end_lsn=101, flags=0, commit_ts=ts),
        message(20, "begin", xid=2, final_lsn=200, commit_ts=ts),
        message(21, "update", ident=x, ident_is_key=False, new_row=z),
        message(22, "delete", ident=y, ident_is_key=False),
        message(23, "insert", new_row=x),
        message(24, "commit", commit_lsn=200, end_lsn=201, flags=0, commit_ts=ts),
    ]
    ing.store_batch(frame(spark, messages), 0, root)

    def values():
        return sorted(r.a for r in jobs.restore_table(spark, root, OID).rows.collect())

    assert values() == ["x", "x", "z"]
    jobs.compact(spark, root, OID, 100)
    assert values() == ["x", "x", "z"]


def test_keys_of_a_typed_snapshot_meet_the_keys_of_the_log(spark, root):
    """A snapshot read from a database is typed; the log writes the same keys as text."""
    columns = [(True, "k", 16, -1), (True, "n", 701, -1), (True, "t", 1184, -1), (False, "raw", 17, -1)]
    relation = Row(**{**RELATION.asDict(), "columns": [Row(is_key=c[0], name=c[1], type_oid=c[2], typmod=c[3]) for c in columns]})
    ts = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame(
        [(True, 1.0, ts, bytearray(b"\x00a")), (False, 2.5, ts, None)], "k boolean, n double, t timestamp, raw binary"
    )
    store.write_snapshot(rows, relation, 50, root)
    stamp = ("t", "2024-01-01 12:00:00+00")
    messages = [
        message(10, "begin", xid=1, final_lsn=100, commit_ts=T0),
        message(12, "update", new_row=[("t", "f"), ("t", "2.5"), stamp, ("t", "\\x01")]),
        message(13, "update", new_row=[("t", "t"), ("t", "1"), stamp, ("u", None)]),
        message(15, "commit", commit_lsn=100, end_lsn=101, flags=0, commit_ts=T0),
    ]
    ing.store_batch(frame(spark, messages), 0, root)
    got = sorted((r.k, r.n, r.t, bytes(r.raw)) for r in jobs.restore_table(spark, root, OID).rows.collect())
    assert got == [(False, 2.5, ts, b"\x01"), (True, 1.0, ts, b"\x00a")]


def test_untracked_tables_are_not_stored(spark, root):
    messages = transactions_of(sequential.random_log(1, 10))
    other = [{**m, "relation_oid": 99} for m in messages]
    tables = spark.createDataFrame([(OID,)], "relation_oid bigint")
    ing.store_batch(frame(spark, messages + other), 0, root, tables=tables)
    assert [r.relation_oid for r in store.read_changes(spark, root).select("relation_oid").distinct().collect()] == [OID]


def test_table_state_versions(spark, tmp_path):
    schema = "relation_oid bigint, messages_since_base bigint"
    staging, archive = str(tmp_path / "s"), str(tmp_path / "a")
    assert store.read_table_state(spark, staging, archive) is None
    store.write_table_state(spark.createDataFrame([(1, 10), (2, 20)], schema), archive)
    store.write_table_state(spark.createDataFrame([(2, 21)], schema), archive)
    store.write_table_state(spark.createDataFrame([(1, 11)], schema), staging)
    got = {r.relation_oid: r.messages_since_base for r in store.read_table_state(spark, staging, archive).collect()}
    assert got == {1: 11, 2: 21}


# --- binary files through the stream -------------------------------------------------------


def packed(m):
    def s(text):
        return text.encode() + b"\0"

    def cells(row):
        out = struct.pack(">H", len(row))
        for kind, value in row:
            out += kind.encode() + (struct.pack(">I", len(value.encode())) + value.encode() if kind == "t" else b"")
        return out

    def micros(ts):
        return int((ts - datetime.datetime(2000, 1, 1)) / datetime.timedelta(microseconds=1))

    kind = m["msg_type"]
    if kind == "begin":
        return b"B" + struct.pack(">QqI", m["final_lsn"], micros(m["commit_ts"]), m["xid"])
    if kind == "commit":
        return b"C" + struct.pack(">BQQq", 0, m["commit_lsn"], m["end_lsn"], micros(m["commit_ts"]))
    oid = struct.pack(">I", m["relation_oid"])
    if kind == "relation":
        out = b"R" + oid + s(m["namespace"]) + s(m["name"]) + m["replica_identity"].encode() + struct.pack(">H", len(m["columns"]))
        for is_key, name, type_oid, typmod in m["columns"]:
            out += bytes([is_key]) + s(name) + struct.pack(">Ii", type_oid, typmod)
        return out
    if kind == "insert":
        return b"I" + oid + b"N" + cells(m["new_row"])
    ident = (b"K" + cells(m["ident"])) if m.get("ident") else b""
    if kind == "delete":
        return b"D" + oid + ident
    return b"U" + oid + ident + b"N" + cells(m["new_row"])


def test_binary_stream_end_to_end(spark, tmp_path):
    log = sequential.random_log(55, 60, moves=False)
    messages = transactions_of(log)
    landing = tmp_path / "landing" / str(OID) / "deltas"
    landing.mkdir(parents=True)
    root, lsn, names_seen, written = str(tmp_path / "archive"), 0, {}, []

    def write(part):
        nonlocal lsn
        first = next((m["final_lsn"] for m in part if m["msg_type"] == "begin"), None)
        starts_open = part[0]["msg_type"] != "begin"
        low = lsn if starts_open else first
        lsn = max([m["final_lsn"] for m in part if m["msg_type"] == "begin"], default=lsn)
        n = names_seen[low] = names_seen.get(low, -1) + 1
        frames = [packed(m) for m in part]
        body = b"".join(struct.pack(">Q", 8 + len(f)) + f for f in frames)
        name = f"{low:016x}" + (f".{n}" if n else "")
        (landing / name).write_bytes(struct.pack(">IQQQQI", 0, low, lsn, 0, 0, len(frames)) + body)
        # Files are taken in order of their time, which has to tell them apart.
        written.append(name)
        os.utime(landing / name, (1_700_000_000 + len(written),) * 2)

    def run():
        ing.ingest(spark, str(tmp_path / "landing"), root, root + "/cp", binary=True, max_files=3).awaitTermination()

    pieces = [messages[i : i + 9] for i in range(0, len(messages), 9)]
    for p in pieces[:4]:
        write(p)
    run()
    for p in pieces[4:]:
        write(p)
    run()
    assert store.read_changes(spark, root).count() == len(messages)
    want, _ = sequential.apply(log)
    assert table(jobs.restore_table(spark, root, OID).rows) == want
    # The same files read as a batch give the same table.
    batch = jobs.read_log(spark, str(tmp_path / "landing"))
    ing.store_batch(batch.drop("tx_pos"), 0, root + "2")
    assert table(jobs.restore_table(spark, root + "2", OID).rows) == want


def test_maintained_image(spark, tmp_path):
    log = sequential.random_log(77, 60, moves=False)
    messages = transactions_of(log)
    landing, root = str(tmp_path / "in"), str(tmp_path / "archive")
    for i in range(0, len(messages), 25):
        frame(spark, messages[i : i + 25]).coalesce(1).write.mode("append").parquet(landing)
    hook = live.compact_every(root, 2, [OID])
    ing.ingest(spark, landing, root, root + "/cp", max_files=1, after_store=hook).awaitTermination()
    assert store.latest_snapshot(spark, root, OID) is not None
    assert table(jobs.restore_table(spark, root, OID).rows) == sequential.apply(log)[0]


def test_fixture_schemas_are_the_canonical_ones(spark):
    log = t.messages(t.chg(spark, "/root/testdata/sf0.001"))
    assert [f.name for f in log.schema.fields] == [f.name for f in CHANGES.fields]
    assert catalog.latest_relations(jobs.relations_of(log)).count() == 4
    assert log.groupBy("relation_oid", "pos").count().where(F.col("count") > 1).isEmpty()


def test_uncastable_values_are_kept_and_told(spark, tmp_path):
    relation = Row(
        relation_oid=OID, lsn=1, namespace="public", name="test", replica_identity="d",
        columns=[Row(is_key=k, name=n, type_oid=o, typmod=m) for k, n, o, m in ((True, "k", 23, -1), (False, "d", 1082, -1), (False, "n", 1700, (10 << 16 | 2) + 4))],
    )
    rows = spark.createDataFrame([("1", "infinity", "1.50"), ("2", "2024-01-01", "NaN"), ("3", "0044-03-15 BC", None)], "k string, d string, n string")
    root = str(tmp_path / "archive")
    store.write_snapshot(rows, relation, 8, root)
    restored = jobs.restore_table(spark, root, OID)
    assert restored.uncastable == {"d": 2, "n": 1}
    assert sorted(map(tuple, restored.rows.collect())) == [(1, "infinity", "1.50"), (2, "2024-01-01", "NaN"), (3, "0044-03-15 BC", None)]
    with pytest.raises(Exception, match="no date in column d"):
        store.read_snapshot(spark, store.latest_snapshot(spark, root, OID)).collect()


def test_time_stops_before_the_first_later_commit(spark):
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    log = spark.createDataFrame([("commit", 1000, at(1)), ("commit", 2000, at(5)), ("commit", 3000, at(2))], "msg_type string, final_lsn long, commit_ts timestamp")
    assert jobs._lsn_at(log, at(3)) == 1000
    assert jobs._lsn_at(log, at(5)) == 3000
    assert jobs._lsn_at(log, at(0)) is None


def test_strange_file_names_are_an_error(spark, tmp_path):
    from tidelog.sources.segments import list_segments

    (tmp_path / "1").mkdir()
    (tmp_path / "1" / f"{1:016x}").write_bytes(b"x" * 40)
    assert list_segments(spark, str(tmp_path)).count() == 1
    (tmp_path / "1" / f"{2:016x}.bak").write_bytes(b"x" * 40)
    with pytest.raises(ValueError, match="not named like a segment"):
        list_segments(spark, str(tmp_path))


def test_miscounted_copy_lines_fail(spark):
    from tidelog.sources.copytext import parse_copy_lines

    columns = [{"name": "a", "type_oid": 20, "typmod": -1}, {"name": "b", "type_oid": 25, "typmod": -1}]
    for line, told in (("1", "without 2 fields"), ("1\tx\ty", "without 2 fields"), ("z\tx", "no bigint in column a")):
        with pytest.raises(Exception, match=told):
            parse_copy_lines(spark.createDataFrame([(line,)], "value string"), columns).collect()


def _landed(folder, first, n):
    folder.mkdir(parents=True, exist_ok=True)
    for i in range(first, first + n):
        (folder / f"{i:016x}").write_bytes(struct.pack(">IQQQQI", 0, i, i, 0, 0, 0) + bytes(8))
    return {f"file:{folder}/{i:016x}" for i in range(first, first + n)}


def test_landed_files_are_taken_once_and_not_named_in_the_driver(spark, tmp_path, monkeypatch):
    from tidelog.streaming import landing

    monkeypatch.setattr(landing, "EVERY", 2)
    root, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    want = _landed(tmp_path / "in" / str(OID) / "deltas", 1, 100)
    first = landing.take(spark, root, cp, 0)
    assert {r.path for r in first.collect()} == want and first.agg(F.sum("length")).first()[0] == 100 * 48
    assert len(first.inputFiles()) < 10
    # A repeated batch takes what it took, whatever has landed since.
    later = _landed(tmp_path / "in" / str(OID + 1) / "deltas", 1, 3)
    assert {r.path for r in landing.take(spark, root, cp, 0).collect()} == want
    assert {r.path for r in landing.take(spark, root, cp, 2).collect()} == later
    assert landing.take(spark, root, cp, 3) is None
    for batch in (4, 5, 6):
        new = _landed(tmp_path / "in" / str(OID) / "deltas", 100 + batch, 1)
        assert {r.path for r in landing.take(spark, root, cp, batch).collect()} == new
    assert len(commits.read_commit(spark, cp + "/landed", 5)["taken"]) <= 2
    assert {r.path for r in landing.take(spark, root, cp, 5).collect()} == {f"file:{tmp_path}/in/{OID}/deltas/{105:016x}"}
    with pytest.raises(ValueError, match="batch 3"):
        landing.take(spark, root, cp, 3)


def test_binary_ingest_lists_no_files_in_the_driver(spark, tmp_path, monkeypatch):
    """Batch after batch of what has landed, without Spark's file source; its own checkpoints go on with it."""
    log = transactions_of(sequential.random_log(7, 30, moves=False))
    root, deltas = str(tmp_path / "archive"), tmp_path / "landing" / str(OID) / "deltas"
    deltas.mkdir(parents=True)

    def write(n, part):
        body = b"".join(struct.pack(">Q", 8 + len(f)) + f for f in map(packed, part))
        (deltas / f"{n:016x}").write_bytes(struct.pack(">IQQQQI", 0, n, n, 0, 0, len(part)) + body)

    def run(where, cp):
        ing.ingest(spark, str(tmp_path / "landing"), where, cp, binary=True).awaitTermination()

    half = len(log) // 2
    write(1, log[:half])
    seen = []
    monkeypatch.setattr(ing, "stream_changes", lambda *a, real=ing.stream_changes, **k: seen.append(a) or real(*a, **k))
    run(root, root + "/cp")
    write(2, log[half:])
    run(root, root + "/cp")
    run(root, root + "/cp")  # nothing new
    assert not seen
    assert store.read_changes(spark, root).count() == len(log)
    assert commits.newest_version(spark, root) == 2
    # A checkpoint of the file source.
    old = tmp_path / "old"
    (old / "cp" / "sources" / "0").mkdir(parents=True)
    (old / "cp" / "sources" / "0" / "0").write_text("v1")
    from tidelog.streaming import landing

    assert landing.taken_by_file_source(spark, str(old / "cp")) and not landing.taken_by_file_source(spark, root + "/cp")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ing.ingest(spark, str(tmp_path / "none"), root, root + "/cp2", binary=True)
