"""Queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow written table that may be broadcast: some 50 MB in memory.
BROADCAST_ROWS = 500_000

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow written table, marked for broadcast if it is counted to be small enough.

    Beyond the bound it stays unmarked, and joins shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def release() -> None:
    """Give memory that finished batches leave behind back to the system. Workers outlive their
    tasks, and what one stage held would count against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def set_aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns of the given names renamed, and what to select to have all of its
    columns back: for operators that add columns of those names and give them up again."""
    clash = {c: f"__own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(clash), [F.col(clash.get(c, c)).alias(c) for c in docs.columns]
