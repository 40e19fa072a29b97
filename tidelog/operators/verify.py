"""Are two tables the same, and if not, where do they differ?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.sources.copytext import copy_line


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint: row count and the sum of a 60-bit hash per row.

    Rows are hashed as COPY text, in which no two different rows look alike."""
    digits = F.substring(F.md5(copy_line(*[F.col(c) for c in df.columns])), 1, 15)
    value = F.conv(digits, 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,0)").cast("string").alias("hash_sum"),
    )


def has_rows(df: DataFrame) -> DataFrame:
    """One row, true iff there is any row; reads no further than the first one."""
    return df.limit(1).agg((F.count("*") > 0).alias("has_rows"))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the surplus on the left (positive) or on
    the right (negative). One map-side combined aggregate over both tables."""
    columns = a.columns
    signed = a.withColumn("__w", F.lit(1).cast("bigint")).unionByName(
        b.select(*columns).withColumn("__w", F.lit(-1).cast("bigint"))
    )
    sums = signed.groupBy(*columns).agg(F.sum("__w").cast("bigint").alias("surplus"))
    return sums.where("surplus <> 0")


def verify(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: fingerprints of both tables, number of differing rows, and the verdict."""
    fa = fingerprint(a).select(F.col("row_count").alias("rows_a"), F.col("hash_sum").alias("hash_a"))
    fb = fingerprint(b.select(*a.columns)).select(F.col("row_count").alias("rows_b"), F.col("hash_sum").alias("hash_b"))
    differing = table_diff(a, b).agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).cast("bigint").alias("differing"))
    parts = fa.unionByName(fb, allowMissingColumns=True).unionByName(differing, allowMissingColumns=True)
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    same = (F.col("hash_a") == F.col("hash_b")) & (F.col("rows_a") == F.col("rows_b")) & (F.col("differing") == 0)
    return one.withColumn("equal", same)
