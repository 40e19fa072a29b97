"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The forest is fitted on the driver from a bounded sample of labelled rows (``MAX_ROWS``, those
whose ids hash lowest); it then travels to the tasks as three flat arrays and scores every
document where it is read. Scoring moves nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import documents, query
from tidelog.llm.textstats import FEATURES, with_statistics
from tidelog.llm.trees import Forest, fit

#: Labelled rows used to fit, at most; the sample is the broadcast side of a join, so this bounds it.
MAX_ROWS = 20_000


def held_out(id_col: str = "doc_id") -> Column:
    """Ids kept out of training: CRC-32 of the id as text leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    *, max_rows: int = MAX_ROWS, **options,
) -> Forest:
    """A forest from the labelled documents outside the held-out fold.

    Null ids and null labels teach nothing; an id with labels of both kinds counts as 1 if at
    least half of them are. Without labels the forest scores 0.5.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("__label_id"))
        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("double").alias("__label"))
        .orderBy(F.xxhash64("__label_id"), "__label_id")
        .limit(max_rows)
    )
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(
        F.broadcast(chosen), F.col("__id") == F.col("__label_id")
    )
    rows = with_statistics(known, "__text", ["__id", "__label"], features=True).toArrow()
    order = np.lexsort((np.arange(len(rows)), rows["__id"].to_numpy()))
    features = np.array(rows["features"].to_pylist(), np.float64).reshape(len(rows), len(FEATURES))
    return fit(features[order], rows["__label"].to_numpy()[order], **options)


def score_quality(
    docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "score", carry: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with a score from 0 to 1, higher for label 1; a column
    of that name is replaced.

    A null text scores as the empty text. An empty table gives an empty table.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != score_col]
    return with_statistics(docs, text_col, carry, score=(score_col, forest.score))


def keep_quality(docs: DataFrame, forest: Forest, *, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with the columns they came with."""
    return score_quality(docs, forest, score_col="__score").where(F.col("__score") >= least).select(*docs.columns)


@query("op6_quality_trees")
def op6_quality_trees(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    forest = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, forest, carry=["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
