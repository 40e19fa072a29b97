"""Ordered scans that never put a whole group into one task.

A running value over ``(keys, order)`` is the natural way to carry a transaction header
forward, number messages or find the row in force at a position. A plain window
partitioned by the keys sends every row of a hot key to one task. Here the order axis is
cut into blocks of ``2**bits`` positions instead:

1. each block is summarised (one map-side combined aggregate, one row per key and block),
2. the summaries are scanned, coarse level by coarse level, into a carry-in per block,
3. the carry-in joins back by ``(keys, block)`` and a window runs inside each block.

The join of step 3 and the window share one hash partitioning, so the detail rows are
shuffled once. Blocks depend on positions alone, so a re-run task gets the same blocks.
Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import block_bits as _block_bits
from tidelog.session import cut_lineage
from tidelog.session import materialise as _materialise


@dataclass(frozen=True)
class Last:
    """Last non-null value of ``expr`` up to and including the row."""

    name: str
    expr: Column
    exclusive: bool = False


def Prev(name: str, expr: Column) -> Last:
    """Last non-null value of ``expr`` strictly before the row."""
    return Last(name, expr, exclusive=True)


@dataclass(frozen=True)
class RunningSum:
    name: str
    expr: Column
    exclusive: bool = False


@dataclass(frozen=True)
class RunningMax:
    name: str
    expr: Column
    exclusive: bool = False


def RowNumber(name: str) -> RunningSum:
    return RunningSum(name, F.lit(1).cast("bigint"))


Spec = Last | RunningSum | RunningMax


def _summarise(spec: Spec, value: Column, order: Column) -> Column:
    if isinstance(spec, Last):
        return F.max_by(value, F.when(value.isNotNull(), order))
    return F.sum(value) if isinstance(spec, RunningSum) else F.max(value)


def _over(spec: Spec, value: Column, window) -> Column:
    if isinstance(spec, Last):
        return F.last(value, ignorenulls=True).over(window)
    agg = F.sum(value) if isinstance(spec, RunningSum) else F.max(value)
    return agg.over(window)


def _combine(spec: Spec, inner: Column, carried: Column) -> Column:
    if isinstance(spec, Last):
        return F.coalesce(inner, carried)
    if isinstance(spec, RunningSum):
        return F.coalesce(inner + carried, inner, carried)
    return F.greatest(inner, carried)


def _tuple(columns: Sequence[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)


def _carry_in(
    summary: DataFrame, keys: list[str], block: list[str], coarse: list[str], specs: Sequence[Spec], bits: int
) -> DataFrame:
    """Exclusive running values over block summaries.

    ``coarse`` lists ever coarser cuts of the first block column; each one bounds the
    number of summaries that meet in one window partition.
    """
    names = [s.name for s in specs]
    if not coarse:
        window = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
        return summary.select(*keys, *block, *[_over(s, F.col(s.name), window).alias(s.name) for s in specs])
    upper, rest = coarse[0], coarse[1:]
    cut = summary.withColumn(upper, F.shiftright(F.col(block[0]), bits))
    upper_summary = cut.groupBy(*keys, upper).agg(
        *[_summarise(s, F.col(s.name), _tuple(block)).alias(s.name) for s in specs]
    )
    carried = _carry_in(upper_summary, keys, [upper], rest, specs, bits)
    carried = carried.select(*keys, upper, *[F.col(n).alias(f"{n}__up") for n in names])
    window = Window.partitionBy(*keys, upper).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(carried, [*keys, upper], "left").select(
        *keys,
        *block,
        *[_combine(s, _over(s, F.col(s.name), window), F.col(f"{s.name}__up")).alias(s.name) for s in specs],
    )


#: Rows in memory take at least so many times the bytes of their Parquet files.
_FILE_GROWTH = 10


def _unlike_small(carried: DataFrame) -> DataFrame:
    """``carried`` marked for a merge join unless it is small in memory too.

    Spark takes the bytes of files for the size of a table. Positions shrink to a few bytes a row in
    them, so a table just below the limit of a broadcast would be many times as large in the driver."""
    limit = carried.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(carried._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return carried.hint("merge") if size * _FILE_GROWTH > limit else carried


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    *,
    bits: int | None = None,
    levels: int = 1,
    materialise: bool | None = None,
) -> DataFrame:
    """Add one column per spec to ``df``: running values per ``keys`` along ``order``.

    ``order`` names BIGINT columns (ascending) whose tuple orders the rows of a key. Rows
    are cut into blocks on the last BIGINT of ``order`` and on the exact values before it,
    so ``("pos",)`` cuts positions and ``("final_lsn", "pos")`` cuts inside transactions.
    Order columns listed after a ``None`` only break ties inside a block.

    A window partition holds the rows of one block; the summaries of a key meet in one
    window partition per level. ``levels=1`` suits dense positions (a trillion messages are
    a million blocks of 2**20); ``levels=2`` suits byte positions and times, where a hot key
    may have hundreds of millions of blocks.

    ``materialise`` computes the carry-in (one row per key and block) at once and keeps it as
    a written table, so a chain of scans reads its input once per scan and plans in linear
    size. Without it each scan of a chain doubles the plan below it. The default comes
    from the session setting ``tidelog.scan.materialise``, which is on.
    """
    bits = bits or _block_bits(df.sparkSession)
    order = list(order)
    if None in order:
        at = order.index(None)
        lead, ties = order[:at], order[at + 1 :]
    else:
        lead, ties = order, []
    full_order = [*lead, *ties]
    added = [F.lit(0).alias("__all")] if not keys else []
    keys = list(keys) or ["__all"]
    block = [f"__b{i}" for i in range(len(lead))]
    cuts = [F.col(name) for name in lead[:-1]] + [F.shiftright(F.col(lead[-1]), bits)]
    work = df.select(
        "*",
        *added,
        *[cut.alias(b) for b, cut in zip(block, cuts)],
        *[s.expr.alias(f"{s.name}__in") for s in specs],
    )

    summary = work.groupBy(*keys, *block).agg(
        *[_summarise(s, F.col(f"{s.name}__in"), _tuple(full_order)).alias(s.name) for s in specs]
    )
    coarse = [f"__c{i}" for i in range(levels - 1)]
    carried = _carry_in(summary, keys, block, coarse, specs, bits)
    carried = carried.select(*keys, *block, *[F.col(s.name).alias(f"{s.name}__carry") for s in specs])
    if materialise if materialise is not None else _materialise(df.sparkSession):
        carried = _unlike_small(cut_lineage(carried))

    frame = Window.partitionBy(*keys, *block).orderBy(*full_order)
    upto = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = frame.rowsBetween(Window.unboundedPreceding, -1)
    out = work.join(carried, [*keys, *block], "left")
    results = [
        _combine(
            s,
            _over(s, F.col(f"{s.name}__in"), before if s.exclusive else upto),
            F.col(f"{s.name}__carry"),
        ).alias(s.name)
        for s in specs
    ]
    new = {s.name for s in specs}
    return out.select(*[F.col(c) for c in df.columns if c not in new], *results)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_order: str,
    right_order: str,
    payload: Sequence[str],
    *,
    bits: int | None = None,
    levels: int = 2,
    materialise: bool | None = None,
) -> DataFrame:
    """For each left row the newest right row of its keys with ``right_order <= left_order``.

    The two sides are interleaved along one axis and the right row is carried forward, so
    no pair of rows is ever built. ``right`` holds one row per ``(keys, right_order)``.
    """
    keys = list(keys)
    marks = right.select(
        *keys,
        F.col(right_order).cast("bigint").alias("__at"),
        F.lit(0).alias("__side"),
        F.struct(*[F.col(c) for c in payload]).alias("__right"),
    )
    rows = left.select(
        *keys,
        F.col(left_order).cast("bigint").alias("__at"),
        F.lit(1).alias("__side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
    )
    both = marks.unionByName(rows, allowMissingColumns=True)
    scanned = ordered_scan(
        both, keys, ["__at", None, "__side"], [Last("__found", F.col("__right"))],
        bits=bits, levels=levels, materialise=materialise,
    )
    return scanned.where("__side = 1").select("__left.*", *[F.col(f"__found.{c}").alias(c) for c in payload])
