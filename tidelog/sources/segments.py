"""Binary segment files: listing, headers, frames by byte range, and writing them.

A task reads byte ranges of files and nothing else of them rides through Spark. Small files are
one range each. Larger ones are cut at frames that a sparse index names: one task per file hops
from length to length and notes the first frame of every piece. A position in a relation's stream
is a count of bytes: those of the files before, in order of (first position, postfix), and those
before the frame. So positions need no packing and no numbering of messages.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.lsn import from_hex, segment_lsn, segment_name, segment_postfix_of, shard_path
from tidelog.operators.scan import RunningSum, ordered_scan
from tidelog.operators.segments import segment_postfix
from tidelog.sources.files import file_system, list_files

# Byte layout of a segment file.
HEADER_BYTES = 40
LENGTH_BYTES = 8
_FRAMES_PER_BATCH = 4096
_BYTES_PER_BATCH = 32 * 1024 * 1024
#: Bytes of a file that one task reads.
SPLIT_BYTES = 128 * 1024 * 1024
_CHUNK = 8 * 1024 * 1024
SEGMENT_NAME = r"^[0-9a-f]{16}(\.\d+)?$"


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment files below ``path`` by name and size, listed by tasks; contents are not read.

    Segments lie in a directory called ``deltas`` or after the relation's number. A file there
    that is not named like a segment may hold messages, so it is an error; files elsewhere
    (state, snapshots) are no segments."""
    files = list_files(spark, path)
    name = F.substring_index(F.col("path"), "/", -1)
    strangers = files.where(~name.rlike(SEGMENT_NAME) & F.col("path").rlike(r"/(deltas|\d+)/[^/]+$")).select("path").take(5)
    if strangers:
        raise ValueError(f"files not named like a segment: {[r['path'] for r in strangers]}")
    return named_segments(files.where(name.rlike(SEGMENT_NAME)))


def named_segments(files: DataFrame) -> DataFrame:
    """Files (path, length) with what their paths say: relation, first position and postfix.

    Files that lie below no relation's number hold the whole log, relation 0 here."""
    name = F.substring_index("path", "/", -1)
    oid = F.regexp_extract("path", r"/(\d+)/[^/0-9]*/?[^/]+$", 1).try_cast("bigint")
    return files.select(
        F.coalesce(oid, F.lit(0).cast("bigint")).alias("relation_oid"),
        name.alias("segment_name"),
        segment_lsn(name).alias("min_lsn"),
        segment_postfix_of(name).cast("bigint").alias("postfix"),
        "length",
        "path",
    )


def with_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Header fields of each segment. Segment times are Unix seconds."""

    def number(at: int, size: int):
        return from_hex(F.hex(F.substring(F.col(content), at, size)))

    return files.select(
        "*",
        number(1, 4).alias("checksum"),
        number(5, 8).alias("min_lsn"),
        number(13, 8).alias("max_lsn"),
        F.timestamp_seconds(number(21, 8)).alias("min_ts"),
        F.timestamp_seconds(number(29, 8)).alias("max_ts"),
        number(37, 4).alias("messages"),
    )


def split_frames(files: DataFrame, content: str = "content", mode: str = "FAILFAST") -> DataFrame:
    """One row per frame: ``frame_no`` from 0 and the message ``raw``.

    One segment is one unit of work; its size is bounded by the messages per segment. A
    torn tail fails the job. Under ``PERMISSIVE`` it is the segment's last frame, length bytes
    included, which no message begins with, so decoding marks it as corrupt.
    """
    fail_fast = mode == "FAILFAST"
    kept = [f for f in files.schema.fields if f.name != content]
    schema = T.StructType(
        [*kept, T.StructField("frame_no", T.LongType()), T.StructField("raw", T.BinaryType())]
    )
    names = [f.name for f in kept]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(content))
            rest = batch.select(names)
            # Frames of many segments leave in one batch, so a small segment costs what its frames do.
            rows, numbers, frames, weight = [], [], [], 0
            for row in range(batch.num_rows):
                view = memoryview(data[row].as_buffer())
                at, size, number = HEADER_BYTES, len(view), 0
                while at < size:
                    whole = size - at >= LENGTH_BYTES
                    length = struct.unpack_from(">Q", view, at)[0] if whole else 0
                    if length < LENGTH_BYTES or at + length > size:
                        if fail_fast:
                            raise ValueError(f"torn frame {number} at byte {at} of {size}")
                        frame, at = bytes(view[at:size]), size
                    else:
                        frame, at = bytes(view[at + LENGTH_BYTES : at + length]), at + length
                    rows.append(row)
                    numbers.append(number)
                    frames.append(frame)
                    number, weight = number + 1, weight + len(frame)
                    if len(frames) >= _FRAMES_PER_BATCH or weight >= _BYTES_PER_BATCH:
                        yield split_batch(rest, rows, numbers, frames)
                        rows, numbers, frames, weight = [], [], [], 0
            if frames:
                yield split_batch(rest, rows, numbers, frames)

    def split_batch(rest: pa.RecordBatch, rows: list[int], numbers: list[int], frames: list[bytes]) -> pa.RecordBatch:
        repeated = rest.take(pa.array(rows))
        return pa.RecordBatch.from_arrays(
            [*repeated.columns, pa.array(numbers, pa.int64()), pa.array(frames, pa.binary())], names=[*names, "frame_no", "raw"]
        )

    return files.mapInArrow(split, schema)


def read_headers(files: DataFrame) -> DataFrame:
    """``files`` with the header fields of each (see ``with_header``), of which only the header is read."""
    schema = T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                source, inner = file_system(path)
                with source.open_input_file(inner) as f:
                    heads.append(f.read_at(HEADER_BYTES, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])

    named = [c for c in files.columns if c != "min_lsn"]
    return with_header(files.mapInArrow(run, schema).drop("min_lsn"), "head").select(*named, "checksum", "min_lsn", "max_lsn", "min_ts", "max_ts", "messages")


def frames_between(f, first: int, last: int, fail_fast: bool = True) -> Iterator[tuple[int, bytes]]:
    """(byte, message) of the frames of an open file that begin in [first, last); the first one begins at ``first``.

    A frame cut off by the file's end fails, or comes as it is, length bytes included."""
    size, at, held, base = f.size(), first, b"", first
    while at < last:
        length = 0
        for need in (LENGTH_BYTES, None):
            need = need or length
            if need < LENGTH_BYTES or at + need > size:
                if fail_fast:
                    raise ValueError(f"torn frame at byte {at} of {size}")
                yield at, f.read_at(size - at, at)
                return
            if at + need > base + len(held):
                # Nothing beyond the range is read, but for the end of its last frame.
                held, base = f.read_at(max(need, min(_CHUNK, last - at)), at), at
            length = length or struct.unpack_from(">Q", held, at - base)[0]
        yield at, held[at - base + LENGTH_BYTES : at - base + length]
        at += length


def frame_index(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, first, last, frame_no): where to cut files longer than ``split_bytes``.

    One task per file reads the length of every frame and steps over the frame; of the file it
    keeps one row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, inner = file_system(path)
                with source.open_input_file(inner) as f:
                    size, at, number, cuts = f.size(), HEADER_BYTES, 0, [(HEADER_BYTES, 0)]
                    while at + LENGTH_BYTES <= size:
                        (length,) = struct.unpack(">Q", f.read_at(LENGTH_BYTES, at))
                        if length < LENGTH_BYTES:
                            break  # torn: whoever reads the last piece says so
                        at, number = at + length, number + 1
                        if at - cuts[-1][0] >= split_bytes and at < size:
                            cuts.append((at, number))
                ends = [at for at, _ in cuts[1:]] + [size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(cuts)), pa.array([a for a, _ in cuts], pa.int64()), pa.array(ends, pa.int64()), pa.array([n for _, n in cuts], pa.int64())],
                    ["path", "first", "last", "frame_no"],
                )

    return files.select("path").repartition("path").mapInArrow(run, "path string, first bigint, last bigint, frame_no bigint")


def read_frames(files: DataFrame, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per frame of the files (path, length and any other columns): the files' columns
    but ``length``, ``frame_no`` from 0, ``byte`` (where it begins) and the message ``raw``.

    A torn tail fails the job. Under ``PERMISSIVE`` it is the file's last frame, length bytes
    included, which no message begins with, so decoding marks it as corrupt."""
    fail_fast = mode == "FAILFAST"
    kept = [f for f in files.schema.fields if f.name != "length"]
    small = files.where(F.col("length") <= split_bytes).select(
        *[f.name for f in kept], F.lit(HEADER_BYTES).cast("bigint").alias("first"), F.col("length").alias("last"), F.lit(0).cast("bigint").alias("frame_no")
    )
    large = files.where(F.col("length") > split_bytes)
    cut = large.join(frame_index(large, split_bytes), "path").select(*small.columns)
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(2 * total // split_bytes + 1, min(files.sparkSession.sparkContext.defaultParallelism, total // _CHUNK + 1))
    ranges = small.unionByName(cut).repartition(int(tasks), "path", "first")
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in ("frame_no", "byte")], T.StructField("raw", T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(names)
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "first", "last", "frame_no")]
            for row, (path, first, last, number) in enumerate(zip(*columns)):
                source, inner = file_system(path)
                with source.open_input_file(inner) as f:
                    held, weight = [], 0
                    for found in frames_between(f, first, last, fail_fast):
                        held.append(found)
                        weight += len(found[1])
                        if len(held) >= _FRAMES_PER_BATCH or weight >= _BYTES_PER_BATCH:
                            yield _frames(rest, row, number, held)
                            number, held, weight = number + len(held), [], 0
                    if held:
                        yield _frames(rest, row, number, held)

    return ranges.mapInArrow(run, schema)


def _frames(rest: pa.RecordBatch, row: int, number: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(held)
    repeated = rest.take(pa.array([row] * n))
    return pa.RecordBatch.from_arrays(
        [*repeated.columns, pa.array(range(number, number + n), pa.int64()), pa.array([b for b, _ in held], pa.int64()), pa.array([m for _, m in held], pa.binary())],
        names=[*repeated.schema.names, "frame_no", "byte", "raw"],
    )


def with_stream_position(files: DataFrame) -> DataFrame:
    """``files`` with ``start``: bytes of the relation's files that come before, by (first position, postfix)."""
    before = RunningSum("__before", F.col("length"), exclusive=True)
    placed = ordered_scan(files, ["relation_oid"], ["min_lsn", "postfix"], [before], levels=2)
    return placed.withColumn("start", F.coalesce("__before", F.lit(0).cast("bigint"))).drop("__before")


def read_segments(spark: SparkSession, path: str, mode: str = "FAILFAST", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of all segments below ``path`` with ``pos``, the byte of the relation's stream that each begins at."""
    files = with_stream_position(list_segments(spark, path))
    frames = read_frames(files.select("relation_oid", "segment_name", "min_lsn", "postfix", "path", "length", "start"), mode, split_bytes)
    return frames.withColumn("pos", F.col("start") + F.col("byte")).drop("start")


def write_segment_files(messages: DataFrame, root: str, chosen: Column | None = None) -> DataFrame:
    """Messages (relation_oid, segment_id, pos, raw, final_lsn, commit_ts) as segment files below
    ``root``, named by first position and postfix; returns relation, name, path, messages and bytes of
    each once it is read. ``chosen`` picks segments, which keep the names they have among all.

    A task writes whole segments, one at a time. A file appears under its name when it is complete,
    and a repeated task replaces its files by equal ones."""
    bounds = messages.groupBy("relation_oid", "segment_id").agg(
        F.min("final_lsn").alias("min_lsn"), F.max("final_lsn").alias("max_lsn"), F.min(F.unix_seconds("commit_ts")).alias("t0"),
        F.max(F.unix_seconds("commit_ts")).alias("t1"), F.count("*").alias("messages"),
    ).withColumn("min_lsn", F.coalesce("min_lsn", F.lit(0).cast("bigint")))
    named = segment_postfix(bounds).withColumn("path", F.concat_ws("/", F.lit(root), shard_path(F.col("relation_oid")), F.lit("deltas"), segment_name(F.col("min_lsn"), F.col("postfix"))))
    named = named if chosen is None else named.where(chosen)
    rows = messages.select("relation_oid", "segment_id", "pos", "raw").join(named, ["relation_oid", "segment_id"])
    # By path: a shuffle by the keys of the join would be left out as done already, and a join that
    # turns into a broadcast while it runs reads its input unshuffled, parts of a segment in many tasks.
    rows = rows.repartition("path").sortWithinPartitions("path", "pos")
    facts = ["relation_oid", "segment_name", "path", "min_lsn", "max_lsn", "t0", "t1", "messages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, target, size = None, None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if path is not None:
                target.close()
                source, inner = file_system(path)
                source.move(f"{inner}.part", inner)
                yield pa.RecordBatch.from_pylist([{"relation_oid": fact["relation_oid"], "segment_name": fact["segment_name"], "path": path, "messages": fact["messages"], "bytes": size}], schema=out)

        out = pa.schema([("relation_oid", pa.int64()), ("segment_name", pa.string()), ("path", pa.string()), ("messages", pa.int64()), ("bytes", pa.int64())])
        fact: dict = {}
        for batch in batches:
            paths, raws = batch.column(batch.schema.get_field_index("path")).to_pylist(), batch.column(batch.schema.get_field_index("raw")).to_pylist()
            for row, (this, raw) in enumerate(zip(paths, raws)):
                if this != path:
                    yield from close()
                    path, fact = this, {c: batch.column(batch.schema.get_field_index(c))[row].as_py() for c in facts}
                    source, inner = file_system(path)
                    source.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    target = source.open_output_stream(f"{inner}.part")
                    numbers = [fact[c] or 0 for c in ("min_lsn", "max_lsn", "t0", "t1", "messages")]
                    target.write(struct.pack(">IQQQQI", 0, *numbers))
                    size = HEADER_BYTES
                target.write(struct.pack(">Q", LENGTH_BYTES + len(raw)) + raw)
                size += LENGTH_BYTES + len(raw)
        yield from close()

    return rows.select(*facts, "raw").mapInArrow(run, "relation_oid bigint, segment_name string, path string, messages bigint, bytes bigint")
