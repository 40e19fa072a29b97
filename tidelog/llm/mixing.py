"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional copies.

A source gets its share of the mix by weight, but at most ``max_epochs`` times its own size;
what is clamped off goes to the others by weight until nobody is above the clamp. Sorted by
clamp per weight, the clamped sources are a prefix, so the water level follows from running
sums over one row per source.

Which documents get the extra copy is decided by a seeded hash. A source is cut into buckets
of that hash, so the running size of a hot source is a sum over bucket totals plus a window
inside one bucket; no source ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.registry import documents, query, set_aside

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies")


def word_count(text: Column) -> Column:
    """Words of the text; none where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(seed: int, id_col: str, text_col: str) -> Column:
    """60 seeded bits per document, the same in every run. The text takes part so that rows without id spread."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``sources`` (one row each, with ``source_size`` and ``weight``) with ``target`` added.

    Targets sum to ``share`` times all sizes, or to all clamps if that is less. A source of
    weight or size zero gets 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ranked = sources.withColumn(
        "__ratio", F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    )
    order = Window.orderBy("__ratio", *[c for c in ("__none", "__source") if c in sources.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weights = F.sum("weight").over(after)
    return (
        ranked.withColumn("__level", F.when(weights > 0, left / weights))
        .withColumn("__level", F.first(F.when(F.col("__level") <= F.col("__ratio"), F.col("__level")), True).over(whole))
        .withColumn(
            "target",
            F.when(F.col("weight") > 0, F.least(cap, F.coalesce(F.col("__level") * F.col("weight"), cap))).otherwise(0.0),
        )
        .drop("__ratio", "__level")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    seed: int = 17,
    buckets: int = BUCKETS,
    carry: bool = False,
) -> DataFrame:
    """How often the mix takes each document: ``size`` (words), ``source_size``, ``target``
    (words of the source in the mix) and ``copies``, beside id and source; ``carry`` keeps all
    columns of ``docs`` instead.

    Sources in code point order, null last as a source of its own, take ``weights`` in turn.
    Every document of a source is taken floor(target / source_size) times; the rest of the
    target comes from documents in the order of a seeded hash, each counted in if at least half
    of it fits. So a source misses its target by half a document at most, and no document is
    taken more often than ``max_epochs`` rounded up. A null or empty text has size 0 and follows
    the same rule. Rows that repeat id and text draw the same number and are told apart
    arbitrarily, which changes no total. Columns named like the added ones are replaced; an empty table gives an empty one.
    """
    docs = docs.drop(*ADDED)
    columns = docs.columns if carry else list(dict.fromkeys([id_col, source_col]))
    base = (
        docs.select(
            *columns,
            F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
            F.col(source_col).isNull().cast("int").alias("__none"),
            word_count(F.col(text_col)).alias("size"),
            draw(seed, id_col, text_col).alias("__draw"),
        )
        .withColumn("__bucket", F.pmod("__draw", F.lit(buckets)).cast("int"))
    )
    cell = ["__none", "__source", "__bucket"]
    cells = base.groupBy(*cell).agg(F.sum("size").alias("__cell"))
    sources = cells.groupBy("__none", "__source").agg(F.sum("__cell").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("__none", "__source")) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.element_at(turn, (rank % len(weights) + 1).cast("int")))
    sources = water_fill(sources, share, max_epochs)
    running = Window.partitionBy("__none", "__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("__before", F.coalesce(F.sum("__cell").over(running), F.lit(0).cast("bigint")))
        .join(sources, ["__none", "__source"])
        .drop("__cell", "weight")
    )
    inside = Window.partitionBy(*cell).orderBy("__draw", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    budget = F.col("target") - whole * F.col("source_size")
    middle = F.col("__before") + F.sum("size").over(inside) - F.col("size") / 2.0
    return (
        base.join(cells, cell)
        .withColumn("__middle", middle)
        .withColumn("copies", (whole + F.when((budget > 0) & (F.col("__middle") <= budget), 1).otherwise(0)).cast("bigint"))
        .select(*columns, "size", "source_size", "target", "copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with."""
    plain, columns = set_aside(docs, ADDED)
    found = mix(plain, carry=True, **options).where("copies > 0")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*columns)


@query(
    "op9_source_mixing",
    r"""
    WITH d AS (
      SELECT doc_id, source, coalesce(source, '') AS s, (source IS NULL)::int AS none,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
             ('0x' || substr(md5(concat_ws(':', '17', doc_id::varchar, md5(coalesce(text, '')))), 1, 15))::bigint AS draw
      FROM documents),
    s AS (SELECT none, s, sum(size)::bigint AS source_size FROM d GROUP BY none, s),
    w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY none, s) - 1) % 3 + 1)::int]::double AS weight FROM s),
    r AS (SELECT *, source_size * 2.0::double AS cap, source_size * 2.0::double / weight AS ratio FROM w),
    l AS (SELECT *,
            (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER (ORDER BY ratio, none, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, none, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM r),
    t AS (SELECT none, s, source_size,
            least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight, cap)) AS target
          FROM l),
    m AS (SELECT doc_id, size, source_size, target,
            CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
            sum(size) OVER (PARTITION BY none, s ORDER BY draw % 4096, draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::double AS middle
          FROM d JOIN t USING (none, s))
    SELECT doc_id, size, source_size, target,
           ((whole + CASE WHEN target - whole * source_size > 0 AND middle <= target - whole * source_size THEN 1 ELSE 0 END) * size)::bigint AS taken
    FROM m
    """,
)
def op9_source_mixing(spark, sf_dir):
    found = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
