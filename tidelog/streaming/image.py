"""A maintained image: every table's rows, kept up to date by rewriting the buckets that change.

Rows of a table lie in ``BUCKETS`` directories by a hash of their key. To bring the image forward,
the committed changes since its position are read, their keys (old ones too) name the buckets they
touch, and only those are read, replayed and written again. One commit replaces the old
directories by the new ones, so a reader sees the image of one position. Which tables to advance
is read from the commit of the batch; no list of tables is given.

Tables without a key, a truncate, and a change of schema rewrite all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.types import canonical_text, strictly_typed
from tidelog.operators import replay
from tidelog.plans import jobs
from tidelog.schema import RELATIONS
from tidelog.sources import commits, store
from tidelog.streaming import ingest as ing

BUCKETS = 64
#: Tables whose images a batch brings forward side by side.
TABLES_AT_ONCE = 4


def _root(root: str, oid: int) -> str:
    return f"{root}/image/{oid}"


def _bucket(names: list[str], buckets: int):
    return F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("bigint")


def position(spark: SparkSession, root: str, oid: int) -> int | None:
    """Position that the image of a table stands at."""
    version = commits.newest_version(spark, _root(root, oid))
    return commits.read_commit(spark, _root(root, oid), version)["ingest"][0][0] if version else None


def _schema(spark: SparkSession, root: str, oid: int) -> Row | None:
    path = commits.ingest_state(spark, _root(root, oid))
    return None if path is None else spark.read.schema(RELATIONS).parquet(path).first()


def _rows(spark: SparkSession, paths: list[str], columns: list) -> DataFrame:
    schema = ", ".join(f"`{c['name']}` string" for c in columns)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_image(spark: SparkSession, root: str, oid: int) -> DataFrame | None:
    """Rows of a table's image, typed; None before its first commit."""
    relation = _schema(spark, root, oid)
    if relation is None:
        return None
    paths = [r["path"] for r in commits.live_segments(spark, _root(root, oid)).select("path").collect()]
    return strictly_typed(_rows(spark, paths, relation["columns"]), relation["columns"])


def _touched(rows: DataFrame, columns: list, buckets: int) -> list[int]:
    """Buckets of the keys that changes leave or enter."""
    part, keys, _ = replay.row_changes(rows, columns)
    kinds = {c["name"]: c for c in columns}
    text = lambda name, key: canonical_text(F.col(name), kinds[key]["type_oid"], kinds[key]["typmod"])
    new = part.select(*[text(k, k).alias(k) for k in keys])
    old = part.where(F.col(f"old_{keys[0]}").isNotNull()).select(*[text(f"old_{k}", k).alias(k) for k in keys])
    # At most one row per bucket.
    return [r["b"] for r in new.unionByName(old).select(_bucket(keys, buckets).alias("b")).distinct().collect()]


def advance(spark: SparkSession, root: str, oid: int, buckets: int = BUCKETS) -> int:
    """Bring the image of a table to the newest committed position; how many buckets were rewritten."""
    state = ing.read_state(spark, root).where(F.col("relation_oid") == oid).select("committed_lsn").first()
    upto = None if state is None else state["committed_lsn"]
    at, pinned = position(spark, root, oid), _schema(spark, root, oid)
    if upto is None or upto == at:
        return 0
    log = store.read_changes(spark, root, oid, after_lsn=at, upto_lsn=upto)
    effective = log.where("final_lsn is not null")
    layouts, barrier = jobs._layouts(log, effective, pinned)
    if not layouts:
        return 0
    groups, relation = jobs._key_groups(layouts), layouts[-1][1]
    columns = relation["columns"]
    rows = effective.where(F.col("msg_type").isin("insert", "update", "delete"))
    live = commits.live_segments(spark, _root(root, oid))
    held = {} if live is None else {r["segment_id"]: r["path"] for r in live.select("segment_id", "path").collect()}
    keys = [c["name"] for c in columns if c["is_key"]] if jobs._keyed(relation) else []
    plain = pinned is not None and keys and barrier is None and list(pinned["columns"]) == list(columns)
    touched = _touched(rows, columns, buckets) if plain else list(range(buckets))
    paths = [held[b] for b in touched if b in held] if plain else list(held.values())
    text = None if pinned is None else _rows(spark, paths if barrier is None else [], pinned["columns"])
    if barrier is not None:
        rows = rows.where(F.struct(*replay.ORDER) > F.struct(*[F.lit(barrier[c]).cast(rows.schema[c].dataType).alias(c) for c in replay.ORDER]))
    for spans in groups:
        text = jobs._image(rows, spans, text, oid, at)
    target = f"{_root(root, oid)}/rows/{uuid.uuid4().hex}"
    names = keys or [c["name"] for c in columns]
    text.withColumn("__bucket", _bucket(names, buckets)).hint("rebalance", F.col("__bucket")).write.partitionBy("__bucket").parquet(target)
    written = spark.read.schema("__bucket bigint").parquet(target).groupBy("__bucket").agg(F.count("*").alias("messages"))
    added = written.select(
        F.lit(oid).alias("relation_oid"), F.col("__bucket").alias("segment_id"), F.lit(upto).alias("max_lsn"), "messages",
        F.concat(F.lit(f"{target}/__bucket="), F.col("__bucket").cast("string")).alias("path"),
    )
    gone = spark.createDataFrame([(p,) for p in paths] if plain else [(p,) for p in held.values()], "path string")
    schema = f"{_root(root, oid)}/relation/{uuid.uuid4().hex}"
    spark.createDataFrame([jobs._as_relation(relation)], RELATIONS).coalesce(1).write.parquet(schema)
    commits.commit(spark, _root(root, oid), "image", added, gone, (upto, schema))
    return len(touched)


def keep(root: str, buckets: int = BUCKETS, every: int = 1) -> Callable[[SparkSession, int], None]:
    """Hook for ``ingest``: advance the image of the tables that the batch, or the ``every`` last ones, changed."""

    def after_store(spark: SparkSession, batch_id: int) -> None:
        if (batch_id + 1) % every:
            return
        changed = commits.live_segments(spark, root).where(F.col("batch_id") > batch_id - every)
        oids = [row["relation_oid"] for row in changed.where("relation_oid > 0").select("relation_oid").distinct().collect()]
        # Tables have images and commits of their own, and the jobs of one leave cores to the others.
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            list(pool.map(lambda oid: advance(spark, root, oid, buckets), oids))

    return after_store
