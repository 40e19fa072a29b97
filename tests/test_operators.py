"""Segments, transactions, catalog, state and verification on small golden inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.fixtures import tables as t
from tidelog.operators import catalog, render, segments, state, transactions, verify


def test_split_transaction(spark):
    """Five messages of one transaction, three per segment."""
    kinds = ["begin", "insert", "insert", "insert", "commit"]
    rows = [(1, i, k, 7 if k == "begin" else None, 500 if k == "begin" else None) for i, k in enumerate(kinds)]
    log = spark.createDataFrame(rows, "relation_oid bigint, pos bigint, msg_type string, xid int, final_lsn bigint")
    cut = segments.segment_by_count(transactions.stitch_transactions(log, bits=1), 3, bits=1)
    named = segments.segment_postfix(segments.segment_stats(cut)).orderBy("postfix").collect()
    assert [(r.messages, r.min_lsn, r.max_lsn, r.segment_name) for r in named] == [
        (3, 500, 500, "00000000000001f4"),
        (2, 500, 500, "00000000000001f4.1"),
    ]


def test_segment_order(spark):
    names = ["00000016b374d849", "00000016b374d848.10", "00000016b374d848", "00000016b374d848.1"]
    from tidelog.functions.lsn import segment_lsn, segment_postfix_of

    df = spark.createDataFrame([(1, n) for n in names], "relation_oid bigint, n string")
    df = df.withColumn("min_lsn", segment_lsn(F.col("n"))).withColumn("postfix", segment_postfix_of(F.col("n")))
    assert [r.n for r in segments.ordered_segments(df).collect()] == [
        "00000016b374d848",
        "00000016b374d848.1",
        "00000016b374d848.10",
        "00000016b374d849",
    ]


def test_purge_keeps_segments_that_straddle_the_base(spark):
    segs = spark.createDataFrame(
        [(1, 100, 150), (1, 150, 250), (1, 200, 200), (1, 210, 300)], "relation_oid bigint, min_lsn bigint, max_lsn bigint"
    )
    base = spark.createDataFrame([(1, 200)], "relation_oid bigint, start_lsn bigint")
    gone = segments.obsolete_segments(segs, base).select("min_lsn", "max_lsn").collect()
    assert sorted(map(tuple, gone)) == [(100, 150), (200, 200)]
    kept = segments.live_segments(segs, base).select("min_lsn").collect()
    assert sorted(r.min_lsn for r in kept) == [150, 210]


def test_boundaries_of_ingest_and_restore(spark):
    log = spark.createDataFrame([(1, 99), (1, 100), (1, 101), (2, 5)], "relation_oid bigint, final_lsn bigint")
    base = spark.createDataFrame([(1, 100)], "relation_oid bigint, start_lsn bigint")
    assert sorted(r.final_lsn for r in transactions.drop_superseded(log, base).collect()) == [5, 100, 101]
    assert sorted(r.final_lsn for r in transactions.after_base(log, base).collect()) == [5, 101]


def test_dedupe_keeps_the_first_delivery_and_headless_rows(spark):
    rows = [(1, 10, 1, 5), (1, 10, 1, 50), (1, 10, 2, 6), (1, None, 1, 1), (1, None, 1, 2)]
    log = spark.createDataFrame(rows, "relation_oid bigint, final_lsn bigint, seq int, pos bigint")
    assert sorted(r.pos for r in transactions.dedupe(log).collect()) == [1, 2, 5, 6]


HISTORY = [(10, 10, 30, "a"), (10, 30, None, "b"), (20, 40, None, "a")]


@pytest.mark.parametrize(
    "name,at,strict,want",
    [("a", 0, False, 20), ("a", 20, False, 10), ("a", 35, False, 10), ("a", 35, True, None), ("b", 25, False, None), ("b", 0, False, 10)],
)
def test_name_lookup(spark, name, at, strict, want):
    rows = [(oid, lsn, nxt, "public", n) for oid, lsn, nxt, n in HISTORY]
    history = spark.createDataFrame(rows, "relation_oid bigint, lsn bigint, next_lsn bigint, namespace string, name string")
    asked = spark.createDataFrame([("public", name, at)], "namespace string, name string, at_lsn bigint")
    assert catalog.resolve_name(history, asked, strict=strict).first().relation_oid == want


def test_name_tie_goes_to_the_lower_id(spark):
    history = spark.createDataFrame(
        [(8, 5, None, "s", "n"), (3, 5, None, "s", "n")], "relation_oid bigint, lsn bigint, next_lsn bigint, namespace string, name string"
    )
    asked = spark.createDataFrame([("s", "n", 0)], "namespace string, name string, at_lsn bigint")
    assert catalog.resolve_name(history, asked).first().relation_oid == 3


def test_name_history(spark):
    rows = [(1, 1, "s", "a"), (1, 2, "s", "a"), (1, 3, "s", "b"), (1, 4, "t", "b"), (1, 9, "s", "a")]
    df = spark.createDataFrame(rows, "relation_oid bigint, lsn bigint, namespace string, name string")
    out = catalog.name_changes(df, bits=1).orderBy("lsn").collect()
    assert [(r.lsn, r.next_lsn, r.namespace, r.name) for r in out] == [
        (1, 3, "s", "a"),
        (3, 4, "s", "b"),
        (4, 9, "t", "b"),
        (9, None, "s", "a"),
    ]


def _relation(spark, columns, name="test", identity="d"):
    df = spark.range(1).select(F.lit(16385).cast("bigint").alias("relation_oid"))
    return df.select(
        "relation_oid",
        F.lit(1).cast("bigint").alias("lsn"),
        F.lit("public").alias("namespace"),
        F.lit(name).alias("name"),
        F.lit(identity).alias("replica_identity"),
        t.columns_literal(columns).alias("columns"),
    )


def _c(name, oid, key=False, typmod=-1):
    return {"is_key": key, "name": name, "type_oid": oid, "typmod": typmod}


OLD = [_c("id", 23, True), _c("value", 23), _c("hash", 25)]
NEW = [_c("id", 23, True), _c("value", 20), _c("note", 25), _c("extra", 16)]


def test_schema_diff(spark):
    old, new = _relation(spark, OLD), _relation(spark, NEW, name="re'named", identity="f")
    diff = catalog.schema_diff(old, new)
    assert sorted((r.change, r.old_value, r.new_value) for r in diff.collect()) == sorted(
        [
            ("altered", "value", "value"),
            ("dropped", "hash", None),
            ("added", "note", "note"),
            ("added", "extra", "extra"),
            ("renamed", "test", "re'named"),
            ("identity", "d", "f"),
        ],
        key=lambda r: (r[0], r[1]),
    )
    sql = {r.change: r.sql for r in render.render_ddl(diff, new).collect()}
    assert sql["renamed"] == "alter table \"public\".\"test\" rename to \"re'named\";"
    assert sql["altered"] == "do $_$begin execute 'alter table \"public\".\"re''named\" alter column \"value\" type ' || format_type(20, NULL); end$_$;"
    assert sql["identity"].endswith("replica identity full;")


def test_schema_mismatch(spark):
    a = _relation(spark, OLD)
    assert catalog.schema_mismatches(a, a).isEmpty()
    reordered = _relation(spark, [OLD[0], OLD[2], OLD[1]])
    assert sorted(r.ordinal for r in catalog.schema_mismatches(a, reordered).collect()) == [1, 2]
    longer = _relation(spark, [*OLD, _c("x", 25)], identity="f")
    assert sorted((r.what, r.ordinal) for r in catalog.schema_mismatches(a, longer).collect()) == [("column", 3), ("identity", -1)]


def test_relation_lookup_and_registration(spark):
    both = _relation(spark, OLD).unionByName(_relation(spark, NEW).withColumn("lsn", F.lit(5).cast("bigint")))
    assert catalog.relation_for(both, oid=16385).first().lsn == 5
    known = both.select("relation_oid").where("false")
    assert catalog.register_tables(both, known).first().lsn == 1
    assert catalog.register_tables(both, known, track_new=False).isEmpty()


def test_collected_columns_keep_their_order(spark):
    attributes = spark.createDataFrame(
        [(1, 3, "c", 25, -1, False), (1, 1, "a", 23, -1, False), (1, 2, "b", 25, -1, True), (1, -1, "sys", 26, -1, False)],
        "relation_oid bigint, attnum int, name string, type_oid bigint, typmod int, is_dropped boolean",
    )
    index = spark.createDataFrame([(1, [1])], "relation_oid bigint, key_attnums array<int>")
    columns = catalog.relation_columns(attributes, index)
    heads = spark.createDataFrame([(1,)], "relation_oid bigint")
    got = catalog.collect_relations(heads, columns).first()["columns"]
    assert [(c["name"], c["is_key"]) for c in got] == [("a", True), ("c", False)]


def test_global_flush_position(spark):
    rows = [("A", 1000, None, 1000), ("B", 0, 500, 600), ("C", 700, None, 700)]
    df = spark.createDataFrame(rows, "name string, flush_lsn bigint, first_buffered_lsn bigint, final_lsn bigint")
    assert state.global_flush_lsn(df, strict=False).first()[0] == 700
    assert state.global_flush_lsn(df).first()[0] == 499
    assert state.global_flush_lsn(df.withColumn("first_buffered_lsn", F.lit(None).cast("bigint"))).first()[0] == 1000


def test_compaction_plan(spark):
    now = datetime.datetime(2024, 1, 1, 12)

    def ago(**kw):
        return now - datetime.timedelta(**kw)

    rows = [
        (1, None, 5, 1, ago(minutes=1), None),
        (2, 10, 5, 3, ago(minutes=1), ago(hours=3)),
        (3, 10, 5, 1, ago(hours=2), ago(hours=3)),
        (4, 10, 0, 9, ago(hours=2), ago(hours=3)),
        (5, 10, 5, 9, ago(hours=2), ago(seconds=1)),
        (6, 10, 5, 1, ago(minutes=5), ago(hours=3)),
        (7, 10, 5, 8, ago(minutes=1), ago(hours=3)),
    ]
    df = spark.createDataFrame(
        rows,
        "relation_oid bigint, base_lsn bigint, messages_since_base bigint, deltas_since_base bigint, last_message_ts timestamp, last_base_ts timestamp",
    )
    plan = state.compaction_plan(df, 3, 3600, F.lit(now))
    assert [(r.relation_oid, r.reason) for r in plan.collect()] == [(1, "no_base"), (7, "threshold"), (2, "threshold"), (3, "idle")]
    assert [r.relation_oid for r in state.compaction_plan(df, 3, 3600, F.lit(now), limit=2).collect()] == [1, 7]


def test_table_state_without_anything(spark):
    log = spark.createDataFrame([(1, 10, datetime.datetime(2024, 1, 1))], "relation_oid bigint, final_lsn bigint, commit_ts timestamp")
    segs = spark.createDataFrame([], "relation_oid bigint, max_lsn bigint")
    base = spark.createDataFrame([(2, 50)], "relation_oid bigint, start_lsn bigint")
    got = {r.relation_oid: r for r in state.table_state(log, segs, base).collect()}
    assert (got[1].messages_since_base, got[1].flush_lsn, got[1].base_lsn) == (1, 0, None)
    assert (got[2].messages_since_base, got[2].flush_lsn, got[2].base_lsn) == (0, 50, 50)


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "i int, s string")
    c = spark.createDataFrame([(1, "x"), (2, "\\N"), (2, None)], "i int, s string")
    assert verify.fingerprint(a).first() == verify.fingerprint(b).first()
    assert verify.fingerprint(a).first() != verify.fingerprint(c).first()
    assert verify.verify(a, b).first().equal and not verify.verify(a, c).first().equal
    assert sorted(((r.i, r.s, r.surplus) for r in verify.table_diff(a, c).collect()), key=str) == [(2, "\\N", -1), (2, None, 1)]
    assert verify.has_rows(a).first().has_rows and not verify.has_rows(a.where("false")).first().has_rows


def test_promotion_audit_notices_a_changed_row(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 0, "y"), (1, 1, "z")], "relation_oid bigint, segment_id bigint, v string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 0, "Y")], "relation_oid bigint, segment_id bigint, v string")
    assert {(r.segment_id, r.ok) for r in segments.audit(a, b).collect()} == {(0, False), (1, False)}
    assert segments.audit(a, a).where("not ok").isEmpty()
