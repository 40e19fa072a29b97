"""Joining a log with a small table, one row per relation, without shuffling the log by relation.

A relation may hold a third of a log, so a shuffle by its id alone puts that third into one task.
The small side is counted instead. A few hundred values become literals of the plan: a map, or a
list that reaches the scan. Some thousand rows are broadcast. Beyond that both sides are shuffled
by key; keys with over ``HOT_ROWS`` rows of the log are counted first and salted, so that their rows
spread over ``SALTS`` tasks, and only their row of the small side is copied.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import cut_lineage

#: Rows of the small side that become literals, and that may be broadcast.
LITERALS, BROADCAST = 500, 20_000
SALTS = 64
SALT = "__salt"
#: Rows of one key that may meet in one task. At most one key in so many rows has more.
HOT_ROWS = 100_000
HOT = "__hot"


def join_small(rows: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small``, which has one row per ``keys``.

    ``counts``: (keys, n) with the rows of each key, where the caller has counted them already."""
    keys, small = list(keys), cut_lineage(small)
    if small.count() <= BROADCAST:
        return rows.join(F.broadcast(small), keys, how)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = cut_lineage(counts.where(F.col("n") > HOT_ROWS).select(*keys, F.lit(True).alias(HOT)))
    plain = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # Rows without a key meet nothing and would all go to one task.
    spread = reduce(or_, [F.col(HOT).isNotNull(), *[F.col(k).isNull() for k in keys]])
    salted = rows.join(F.broadcast(hot), keys, "left").select(
        *rows.columns, F.when(spread, F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(0).cast("int").alias(SALT)
    )
    every = F.when(F.col(HOT), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = small.join(F.broadcast(hot), keys, "left").withColumn(SALT, F.explode(every)).drop(HOT)
    # Files are small beside the rows in them, so Spark would think them fit for a broadcast.
    return salted.join(copies.hint("merge"), [*keys, SALT], how).drop(SALT)


def with_value(rows: DataFrame, small: DataFrame, name: str, key: str = "relation_oid") -> DataFrame:
    """``rows`` with the value ``name`` that ``small`` has for their ``key``, or null."""
    small = small.select(key, name)
    found = small.take(LITERALS + 1)
    kind = small.schema[name].dataType
    if len(found) > LITERALS or not isinstance(kind, (T.LongType, T.IntegerType)):
        return join_small(rows, small, [key])
    known = [r for r in found if r[0] is not None and r[1] is not None]
    if not known:
        return rows.withColumn(name, F.lit(None).cast(kind))
    values = F.create_map(*[F.lit(x).cast("bigint") for r in known for x in r])
    return rows.withColumn(name, F.try_element_at(values, F.col(key).cast("bigint")).cast(kind))


def where_key(rows: DataFrame, keys: DataFrame, key: str = "relation_oid", inside: bool = True) -> DataFrame:
    """``rows`` whose ``key`` is (or is not) among ``keys``; a null key is not."""
    keys = keys.select(key).where(F.col(key).isNotNull()).distinct()
    found = [r[0] for r in keys.take(LITERALS + 1)]
    if len(found) <= LITERALS:
        among = F.col(key).isin(found) if found else F.lit(False)
        return rows.where(among if inside else ~among | F.col(key).isNull())
    return join_small(rows, keys, [key], "left_semi" if inside else "left_anti")
