"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

The first pass moves only (hash, id): groups of one row, nearly all, are settled by it. Only
the documents of larger groups are compared byte by byte, by grouping on (hash, text): copies
collapse map-side, so a group that holds a third of all rows costs one row per map task. Tables
of repeated hashes are written to the shared folder and counted: up to a bound they are
broadcast, and beyond it joined by shuffle, where Spark splits hot hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, documents, query, set_aside
from tidelog.session import cut_lineage

MARKS = ("keep_id", "group_size", "kept")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its ``carry`` columns, id among them) with ``keep_id``, ``group_size`` and ``kept`` added; one row out per row in.

    Texts are equal when their bytes are. A null text counts as the empty text. Of equal texts
    the row with the smallest (or ``keep="largest"``) id stays; ids must be comparable. A null
    id never wins against another id; a group with only null ids keeps its rows (``keep_id`` is
    null). Rows that repeat both id and text are the same document and share their fate, but
    count in ``group_size``. Columns named like the added ones are replaced. An empty table
    gives an empty table.
    """
    docs = docs.drop(*MARKS)
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = (F.min if keep == "smallest" else F.max)("__id")
    rows = docs.select(F.col(id_col).alias("__id"), hash_of(text).alias("__hash"))
    repeated = cut_lineage(
        rows.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash")
    )
    # Bytes are compared here: equal texts meet, colliding ones stay apart.
    groups = cut_lineage(
        docs.select(F.col(id_col).alias("__id"), text.alias("__text"), hash_of(text).alias("__hash"))
        .join(bounded(repeated), "__hash", "left_semi")
        .groupBy("__hash", "__text")
        .agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        .select("__hash", F.sha2("__text", 256).alias("__sha"), "keep_id", "group_size")
    )
    collided = cut_lineage(
        groups.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash")
    )
    carry = docs.columns if carry is None else carry
    keyed = docs.select(*carry, hash_of(text).alias("__hash"), *([] if collided.isEmpty() else [F.sha2(text, 256).alias("__sha")]))
    on = ["__hash"]
    if "__sha" in keyed.columns:
        # Different texts share a hash: a second digest tells them apart.
        on = ["__hash", "__sha"]
    else:
        groups = groups.drop("__sha")
    return (
        keyed.join(bounded(groups), on, "left")
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("bigint")))
        .withColumn("keep_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col(id_col)))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .drop("__hash", "__sha")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest"):
    """The documents that stay, with the columns they came with."""
    plain, columns = set_aside(docs, MARKS)
    return exact_duplicates(plain, id_col, text_col, keep=keep).where("kept").select(*columns)


@query(
    "op8_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER w AS keep_id,
           count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def op8_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )
    return exact_duplicates(docs, keep="largest", carry=["doc_id", "text_sha256"])
