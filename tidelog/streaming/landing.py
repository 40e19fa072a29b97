"""Which landed files a batch takes, without their names in the driver.

Below the folder ``landed`` of a checkpoint there is one small record per batch that took files, kept
like the commits of an archive. It names the table of the batch's files and the tables that
together hold all files taken so far. Tasks list, compare and write those. A batch's record is there before
the batch begins, so a repeated batch takes the same files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources import commits
from tidelog.sources.files import list_files

#: Tables of batches that become one.
EVERY = 20


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema("path string, length bigint").parquet(*paths)


def _delete(spark: SparkSession, path: str) -> None:
    files, target = commits._hadoop(spark, path)
    files.delete(target, True)


def take(spark: SparkSession, landing: str, checkpoint: str, batch_id: int) -> DataFrame | None:
    """Files (path, length) below ``landing`` that no batch before took, or None if there are none."""
    root = f"{checkpoint}/landed"
    newest = version = commits.newest_version(spark, root)
    record = {"batch": -1, "taken": []}
    while version and (record := commits.read_commit(spark, root, version))["batch"] > batch_id:
        version -= 1
    if record["batch"] == batch_id:
        return _files(spark, record["files"])
    if version < newest:
        raise ValueError(f"batch {batch_id} took no files, but later ones did")
    work, path, taken = f"{root}/work/{uuid.uuid4().hex}", f"{root}/files/{uuid.uuid4().hex}", record["taken"]
    found = list_files(spark, landing, work)
    if taken:
        # A path takes few bytes in a file: what was taken would seem fit for a broadcast.
        found = found.join(_files(spark, *taken).hint("merge"), "path", "left_anti")
    found.write.parquet(path)
    _delete(spark, work)
    files = _files(spark, path)
    if files.isEmpty():
        _delete(spark, path)
        return None
    taken = [*taken, path]
    if len(taken) > EVERY:
        whole = f"{root}/files/{uuid.uuid4().hex}"
        _files(spark, *taken).write.parquet(whole)
        taken = [whole]
    text = json.dumps({"batch": batch_id, "files": path, "taken": taken})
    if not commits._publish(spark, commits._name(root, version + 1), text):
        raise commits.Conflict(f"another stream with this checkpoint took the files of batch {batch_id}")
    return files


def taken_by_file_source(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream of Spark's file source began this checkpoint, whose log of files only it reads."""
    files, path = commits._hadoop(spark, f"{checkpoint}/sources/0")
    return files.exists(path) and any(not s.getPath().getName().startswith(".") for s in files.listStatus(path))
