"""Session helpers: where shared scratch data lives and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_BITS_CONF = "tidelog.scan.blockBits"
DEFAULT_BLOCK_BITS = 20
MATERIALISE_CONF = "tidelog.scan.materialise"


def shared_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster. A local folder only where none is set and driver and
    executors are one process: elsewhere no other machine would see it, so that is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="tidelog-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    A lost executor then replays from these files and not from the whole chain of rounds
    before them, and readers fetch only the columns they use."""
    path = scratch_dir(df.sparkSession, "cut")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_bits(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_BITS_CONF, str(DEFAULT_BLOCK_BITS)))


def materialise(spark: SparkSession) -> bool:
    return spark.conf.get(MATERIALISE_CONF, "true").lower() == "true"
