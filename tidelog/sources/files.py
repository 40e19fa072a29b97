"""Files that tasks list and open themselves: byte ranges of segments, and directories to be removed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tidelog.session import scratch_dir

#: Entries after which a task leaves the folders that it found to others.
FOLDER_ENTRIES = 1000
#: Files that one task opens, where there are many, and where there are few.
TASK_FILES, FEW_FILES = 4096, 64
_NAMES_PER_BATCH = 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    if urlparse(path).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is it a folder) of what lies in a folder; nothing where the folder is gone."""
    source, inner = file_system(path)
    path = path.rstrip("/")
    if not isinstance(source, pafs.LocalFileSystem):
        for info in source.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if not _hidden(info.base_name):
                yield f"{path}/{info.base_name}", info.size or 0, info.type == pafs.FileType.Directory
        return
    try:
        held = os.scandir(inner)
    except FileNotFoundError:
        return
    with held:
        for entry in held:
            if _hidden(entry.name):
                continue
            try:
                folder = entry.is_dir()
                size = 0 if folder else entry.stat().st_size
            except FileNotFoundError:
                continue
            yield f"{path}/{entry.name}", size, folder


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files below folders (path). Once ``FOLDER_ENTRIES`` were seen, folders not yet opened come as rows themselves."""

    def batch(rows: list[tuple[str, int, bool]]) -> pa.RecordBatch:
        paths, lengths, folders = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(folders, pa.bool_())], ["path", "length", "folder"])

    for given in batches:
        for root in given.column(0).to_pylist():
            waiting, seen, held = [root], 0, []
            while waiting and seen < FOLDER_ENTRIES:
                for entry in _entries(waiting.pop(0)):
                    seen += 1
                    if entry[2]:
                        waiting.append(entry[0])
                    elif entry[1]:
                        held.append(entry)
                    if len(held) >= _NAMES_PER_BATCH:
                        yield batch(held)
                        held = []
            held += [(path, 0, True) for path in waiting]
            if held:
                yield batch(held)


def named_paths(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """(path, length, is it a folder) of what a path names: one file or folder, or those that its wildcards stand for."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    if not found:
        spark.read.format("binaryFile").load(path)  # says that there is no such path
    return [(s.getPath().toString(), s.getLen(), s.isDirectory()) for s in found]


def list_files(spark: SparkSession, path: str, work: str | None = None) -> DataFrame:
    """Files at or below ``path`` (it may have wildcards) by path and length; contents are not read.

    Tasks list the folders and write what they find below ``work``, round by round until no folder is
    left. The driver holds no names, however many files there are. Hidden and empty files are left out,
    as Spark's readers do."""
    work = work or scratch_dir(spark, "listing")
    schema = "path string, length bigint, folder boolean"
    named = [n for n in named_paths(spark, path) if n[2] or (n[1] and not _hidden(n[0].rsplit("/", 1)[-1]))]
    level = spark.createDataFrame(named, schema)
    rounds, tasks = [level], spark.sparkContext.defaultParallelism
    while not level.where("folder").isEmpty():
        at = f"{work}/round-{len(rounds)}"
        level.where("folder").select("path").repartition(tasks, "path").mapInArrow(_list, schema).write.parquet(at)
        level = spark.read.schema(schema).parquet(at)
        rounds.append(level)
    files = reduce(DataFrame.unionByName, [r.where("not folder").select("path", "length") for r in rounds])
    count = files.count()
    spread = max(-(-count // TASK_FILES), min(tasks, -(-count // FEW_FILES)), 1)
    return files.repartition(spread, "path")
