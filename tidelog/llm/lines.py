"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines are one window. The first occurrence of a window, by document id
and position, stays; every later one is covered, in the same document or another. Covered
windows of a document merge into runs of lines, and the runs are removed.

Only (window hash, document, position) is shuffled to find repeats, combined map-side, and only
runs of lines are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.registry import BROADCAST_ROWS, bounded, documents, query
from tidelog.session import cut_lineage

WIDTH = 3
#: A window counts if it has a word.
WORD = r"[^\x20\x09-\x0D]"
ADDED = ("n_lines", "n_removed", "n_runs")


def lines_of(text_col: str) -> Column:
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, digest of the text, first line from 1, 128-bit hash) of each window with a word."""
    at = F.when(F.size("lines") >= width, F.sequence(F.lit(1), F.size("lines") - (width - 1)))
    named = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"), lines_of(text_col).alias("lines")
    )
    each = named.select(
        "id", "digest",
        F.inline(F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("lines", i, width), "\n").alias("window")))),
    )
    return each.where(F.col("window").rlike(WORD)).select("id", "digest", "at", F.unhex(F.md5("window")).alias("hash"))


def covered_runs(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, digest, runs): sorted, disjoint runs [from, to] of lines that later windows cover."""
    place = F.struct("id", "digest", "at")
    repeated = cut_lineage(
        found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    )
    later = found.join(bounded(repeated), "hash").where(~place.eqNullSafe(F.col("first"))).select("id", "digest", "at").distinct()
    inside = Window.partitionBy("id", "digest").orderBy("at")
    fresh = F.coalesce(F.col("at") > F.lag("at").over(inside) + width, F.lit(True)).cast("int")
    islands = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(inside))
    merged = islands.groupBy("id", "digest", "run").agg(
        F.min("at").alias("from"), (F.max("at") + (width - 1)).alias("to")
    )
    return merged.groupBy("id", "digest").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def without_runs(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: what lies between them, in order."""

    def gap(k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(F.get(runs, k - 1)["to"] + 1)
        end = F.when(k == F.size(runs), F.size(lines)).otherwise(F.get(runs, k)["from"] - 1)
        return F.slice(lines, start, end - start + 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), gap))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH) -> DataFrame:
    """``docs`` with the text shortened, and ``n_lines`` (before), ``n_removed`` and ``n_runs`` added.

    Lines are what newlines separate, compared byte by byte, so a text has one line at least. A
    null text counts as the empty one and stays null if nothing goes. Documents are ordered by
    id, null first, then by a digest of the text; rows that repeat both are one document and
    are treated alike. A document shorter than a window stays whole. Columns named like the
    added ones are replaced; an empty table gives an empty table.
    """
    docs = docs.drop(*ADDED)
    runs = cut_lineage(covered_runs(cut_lineage(windows(docs, id_col, text_col, width)), width))
    total = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    runs = runs.withColumnsRenamed({"id": "__run_id", "digest": "__run_digest", "runs": "__runs"})
    marked = docs.withColumns({"__id": F.col(id_col), "__digest": F.xxhash64(F.coalesce(text_col, F.lit("")))})
    joined = marked.join(
        F.broadcast(runs) if total <= BROADCAST_ROWS else runs,
        F.col("__id").eqNullSafe(F.col("__run_id")) & (F.col("__digest") == F.col("__run_digest")),
        "left",
    ).withColumn("__lines", lines_of(text_col))
    removed = F.aggregate("__runs", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1)
    return joined.select(
        *[F.col(c) if c != text_col else
          F.when(F.col("__runs").isNull(), F.col(c)).otherwise(F.array_join(without_runs(F.col("__lines"), F.col("__runs")), "\n")).alias(c)
          for c in docs.columns],
        F.size("__lines").cast("bigint").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.size("__runs"), F.lit(0)).cast("bigint").alias("n_runs"),
    )


@query(
    "op7_line_windows",
    r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, i, array_to_string(lines[i:i+2], chr(10)) AS win
          FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS i FROM d)),
    r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth
          FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
    c AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS pos FROM r WHERE nth > 1),
    l AS (SELECT p.doc_id, p.pos, p.lines[p.pos] AS line, c.pos IS NOT NULL AS gone
          FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS pos FROM d) p
          LEFT JOIN c ON c.doc_id = p.doc_id AND c.pos = p.pos),
    g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM l)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM g GROUP BY doc_id
    """,
)
def op7_line_windows(spark, sf_dir):
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
