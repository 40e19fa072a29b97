"""Every registered query has an oracle; some of each kind are compared here at the smallest
scale, all of them with ``TIDELOG_ALL_QUERIES=1`` (see also ``tidelog.fixtures.check``)."""

import os

import pytest

import __spark_entry__ as entry
from tidelog.fixtures.check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = [
    "replay_keyed",
    "replay_full",
    "replay_truncate",
    "restore_from_base",
    "stitch_tx",
    "tx_summary",
    "segment_combined",
    "segment_manifest",
    "flush_progress",
    "metrics_rollup",
    "table_diff",
    "fingerprint",
    "publication_tables",
    "resolve_name_asof",
    "schema_diff",
    "tuple_long",
    "render_update",
    "inspect_lines",
    "quote_literal",
    "lsn_text",
    "typed_projection",
    "segment_scan",
    "segment_files",
    "segment_stream",
    "inspect_segments",
    "stream_ingest_binary",
    "restore_rekeyed",
    "restore_at_ts",
    "dedupe_redelivery",
    "decode_roundtrip",
    "decode_insert",
    "copy_text_roundtrip",
    "stream_sessions",
    "stream_metrics",
]
CHOSEN = list(entry.QUERIES) if os.environ.get("TIDELOG_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) == ""
