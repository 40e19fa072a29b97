"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` slots for ever. Bytes are summed per slot, and a small versioned
table maps slots to shards. Rebalancing edits that table: it takes from shards above the mean
only what they have too much, and deals that to the shards below it. Whoever reads a version
of the map finds a record from its id alone, and only slots that an edit names move.

The map has one row per slot, so its edits run over a bounded table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.registry import documents, query
from tidelog.session import cut_lineage

SLOTS = 4096
ADDED = ("virtual_slot", "shard", "slot", "size")


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """Slot of a record, from its id; records without id spread by their text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text_col, F.lit("")))))
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, size_col: str = "size") -> DataFrame:
    """Rows and bytes per slot, summed map-side first."""
    return records.groupBy("virtual_slot").agg(F.sum(size_col).alias("bytes"), F.count("*").alias("rows"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn."""
    return spark.range(slots).select(
        F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def current(versions: DataFrame, version: int | None = None) -> DataFrame:
    """Slot to shard as of a version, the newest by default: the last edit of each slot."""
    known = versions if version is None else versions.where(F.col("version") <= version)
    return known.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def rebalance(versions: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The edits (version, virtual_slot, shard) that bring ``shards`` shards to equal bytes.

    ``shards`` may be more than the map has, which opens shards, or fewer, which empties the
    last ones. Every shard keeps its largest slots as long as they fit into the mean; the rest,
    largest first, goes to whichever shard has least. Slots that end where they were are not
    edited, empty slots stay unless their shard closes.
    """
    now = (
        current(versions)
        .join(sizes.select("virtual_slot", "bytes"), "virtual_slot", "left")
        .withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("bigint"))
    )
    inside = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(0))
    marked = (
        now.withColumn("mean", F.sum("bytes").over(everything) / F.lit(float(shards)))
        .withColumn("stays", (F.col("shard") < shards) & ((F.sum("bytes").over(upto) <= F.col("mean")) | (F.col("bytes") == 0)))
    )
    settled = F.array(*[
        F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("bigint")
        for s in range(shards)
    ])
    loose = F.sort_array(
        F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot", F.col("shard").alias("was"))))
    )
    pool = marked.agg(settled.alias("loads"), loose.alias("pool"))
    start = F.struct(F.col("loads").alias("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,was:int>>)").alias("moves"))

    def deal(state, item):
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: F.when(i == at, load - item["less"]).otherwise(load))
        move = F.struct(item["virtual_slot"].alias("virtual_slot"), at.alias("shard"), item["was"].alias("was"))
        return F.struct(loads.alias("loads"), F.concat(state["moves"], F.array(move)).alias("moves"))

    dealt = pool.select(F.aggregate("pool", start, deal)["moves"].alias("moves")).select(F.inline("moves"))
    newest = versions.agg((F.max("version") + 1).cast("int").alias("version"))
    return (
        dealt.where("shard != was")
        .join(F.broadcast(newest))
        .select("version", "virtual_slot", "shard")
    )


def place(records: DataFrame, mapping: DataFrame, order: list[str]) -> DataFrame:
    """``records`` (with ``virtual_slot``) with ``shard`` and ``slot``, the place inside the
    shard, gapless from 0: rows before the virtual slot, plus the rank inside it by ``order``.

    No shard meets in one task, only a virtual slot does.
    """
    counts = records.groupBy("virtual_slot").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.join(mapping, "virtual_slot")
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0).cast("bigint")))
        .select("virtual_slot", "shard", "__before")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    return (
        records.join(offsets, "virtual_slot")
        .withColumn("slot", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__before")
    )


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 8, slots: int = SLOTS
) -> tuple[DataFrame, DataFrame]:
    """(placed rows, all versions of the map).

    Placed rows hold id, ``size`` (UTF-8 bytes of the text, none if null, plus 1), CRC-32 of the
    text, ``virtual_slot``, ``shard`` and ``slot``. Rows without id are spread by their text.
    Repeated rows get places of their own. An empty table gives no rows and an unedited map.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of(id_col, text_col, slots).alias("virtual_slot"),
    )
    versions = first_map(docs.sparkSession, shards, slots)
    edits = rebalance(versions, slot_bytes(records), shards)
    versions = cut_lineage(versions.unionByName(edits).coalesce(1))
    return place(records, current(versions), ["doc_id", "size", "text_crc32"]), versions


@query("op5_virtual_slots")
def op5_virtual_slots(spark, sf_dir):
    placed, _ = shard_documents(documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
