"""Segment files as a data source: ``spark.read.format("tidelog_segments").load(path)``, and the same for streams.

A partition is a byte range of a file, or many small files. Files longer than ``splitBytes`` are cut where a frame
index says (option ``index``: a Parquet table of :func:`tidelog.sources.segments.frame_index`);
without one a file is one partition. A stream's offset is, per relation, the newest segment that
was read, how many of its bytes, and how many bytes of the relation's stream there are up to
there. Segments are taken in log order, which is the order of their names, so it does not
matter when files appear or in which order a store lists them.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidelog.sources.files import file_system
from tidelog.sources.segments import _BYTES_PER_BATCH, _FRAMES_PER_BATCH, HEADER_BYTES, SEGMENT_NAME, SPLIT_BYTES, frame_index, frames_between, list_segments

SCHEMA = "relation_oid bigint, segment_name string, path string, frame_no bigint, pos bigint, raw binary"
_ARROW = pa.schema([
    ("relation_oid", pa.int64()), ("segment_name", pa.string()), ("path", pa.string()), ("frame_no", pa.int64()), ("pos", pa.int64()), ("raw", pa.binary()),
])


#: Bytes and number of small files that one task reads.
PACK_BYTES, PACK_FILES = 4 * 1024 * 1024, 256


@dataclass
class Segment:
    """A file: its relation, its place among the relation's files, and its size."""

    relation: int
    low: int
    postfix: int
    path: str
    length: int

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[1]

    @property
    def order(self) -> tuple[int, int]:
        return self.low, self.postfix


@dataclass
class Piece(InputPartition):
    """Frames of a file that begin in [first, last); ``start`` is the file's place in its relation's stream."""

    segment: Segment
    start: int
    first: int
    last: int
    frame_no: int | None


@dataclass
class Pieces(InputPartition):
    """What one task reads: a piece of a large file, or many small files."""

    held: list[Piece]


def _packed(pieces: list[Piece]) -> list[Pieces]:
    """Pieces dealt to tasks: pieces of one file each alone, whole small files up to ``PACK_BYTES`` and ``PACK_FILES``."""
    out: list[Pieces] = []
    room = files = 0
    for piece in pieces:
        size, whole = piece.last - piece.first, piece.first == HEADER_BYTES and piece.last == piece.segment.length
        if not whole or size > room or files >= PACK_FILES:
            out.append(Pieces([]))
            room, files = PACK_BYTES if whole else 0, 0
        out[-1].held.append(piece)
        room, files = room - size if whole else 0, files + 1
    return out


def _order_of(name: str) -> tuple[int, int]:
    low, _, postfix = name.partition(".")
    return int(low, 16), int(postfix or 0)


def find_segments(root: str) -> list[Segment]:
    """Segment files below a folder, by relation and log order. Names and sizes only."""
    source, inner = file_system(root)
    prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    found = []
    for info in source.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True)):
        if info.type == pafs.FileType.File and re.match(SEGMENT_NAME, info.base_name):
            oid = re.search(r"/(\d+)/[^/0-9]*/?[^/]+$", info.path)
            found.append(Segment(int(oid[1]) if oid else 0, *_order_of(info.base_name), prefix + info.path, info.size))
    return sorted(found, key=lambda s: (s.relation, *s.order))


def _pieces(segment: Segment, start: int, first: int, last: int, cuts: dict[str, list[tuple[int, int]]]) -> Iterator[Piece]:
    """The bytes of a segment from ``first`` to ``last`` as partitions."""
    inside = [(at, number) for at, number in cuts.get(_plain(segment.path), []) if first < at < last]
    edges = [(first, 0 if first == HEADER_BYTES else None), *inside, (last, None)]
    for (a, number), (b, _) in zip(edges, edges[1:]):
        yield Piece(segment, start, a, b, number)


def _plain(path: str) -> str:
    """A path without the scheme of local files, which some listings leave out."""
    return file_system(path)[1] if path.startswith("file:") else path


def _index(options: dict) -> dict[str, list[tuple[int, int]]]:
    if "index" not in options:
        return {}
    source, inner = file_system(options["index"])
    cuts: dict[str, list[tuple[int, int]]] = {}
    for row in pyarrow.dataset.dataset(inner, filesystem=source).to_table().to_pylist():
        cuts.setdefault(_plain(row["path"]), []).append((row["first"], row["frame_no"]))
    return {path: sorted(at) for path, at in cuts.items()}


def _read(pieces: Pieces, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    for piece in pieces.held:
        yield from _frames_of(piece, fail_fast)


def _frames_of(piece: Piece, fail_fast: bool) -> Iterator[pa.RecordBatch]:
    source, inner = file_system(piece.segment.path)
    number = piece.frame_no

    def batch(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(held)
        numbers = [None] * n if number is None else range(number, number + n)
        return pa.RecordBatch.from_arrays(
            [pa.array([piece.segment.relation] * n, pa.int64()), pa.array([piece.segment.name] * n), pa.array([piece.segment.path] * n),
             pa.array(numbers, pa.int64()), pa.array([piece.start + at for at, _ in held], pa.int64()), pa.array([m for _, m in held], pa.binary())],
            schema=_ARROW,
        )

    with source.open_input_file(inner) as f:
        held, weight = [], 0
        for found in frames_between(f, piece.first, piece.last, fail_fast):
            held.append(found)
            weight += len(found[1])
            if len(held) >= _FRAMES_PER_BATCH or weight >= _BYTES_PER_BATCH:
                yield batch(held)
                number = None if number is None else number + len(held)
                held, weight = [], 0
        if held:
            yield batch(held)


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[Pieces]:
        cuts, out, ahead, relation = _index(self.options), [], 0, None
        for segment in find_segments(self.options["path"]):
            ahead = ahead if segment.relation == relation else 0
            relation = segment.relation
            if segment.length > HEADER_BYTES:
                out += _pieces(segment, ahead, HEADER_BYTES, segment.length, cuts)
            ahead += segment.length
        return _packed(out)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options.get("mode", "FAILFAST") == "FAILFAST")


class SegmentStreamReader(DataSourceStreamReader):
    """Offsets: ``{relation: {"segment", "byte", "pos"}}``."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        newest: dict[str, dict] = {}
        for segment in find_segments(self.options["path"]):
            before = newest.get(str(segment.relation), {"pos": 0})
            newest[str(segment.relation)] = {"segment": segment.name, "byte": segment.length, "pos": before["pos"] + segment.length}
        return newest

    def partitions(self, start: dict, end: dict) -> Sequence[Pieces]:
        cuts, out, ahead = _index(self.options), [], {}
        for segment in find_segments(self.options["path"]):
            relation = str(segment.relation)
            upto, done = end.get(relation), start.get(relation)
            at = ahead.get(relation, 0)
            ahead[relation] = at + segment.length
            if upto is None or segment.order > _order_of(upto["segment"]):
                continue
            first, last = HEADER_BYTES, segment.length
            if segment.name == upto["segment"]:
                last = upto["byte"]
            if done is not None and segment.order < _order_of(done["segment"]):
                continue
            if done is not None and segment.name == done["segment"]:
                first = max(first, done["byte"])
            if first < last:
                out += _pieces(segment, at, first, last, cuts)
        return _packed(out)

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.options.get("mode", "FAILFAST") == "FAILFAST")


class SegmentSource(DataSource):
    """Options: ``path``, ``mode`` (FAILFAST or PERMISSIVE), ``index``."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_segments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(dict(self.options))

    def streamReader(self, schema) -> SegmentStreamReader:
        return SegmentStreamReader(dict(self.options))


class LookStreamReader(DataSourceStreamReader):
    """An offset is the time of a look at the landing directory."""

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(end["at"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value,)


class LookSource(DataSource):
    """A stream whose batches say when to look, and hold nothing else. What has landed is then listed by
    tasks (``streaming.landing``); offsets of files would take all their names through the driver."""

    @classmethod
    def name(cls) -> str:
        return "tidelog_looks"

    def schema(self) -> str:
        return "at bigint"

    def streamReader(self, schema) -> LookStreamReader:
        return LookStreamReader()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
    spark.dataSource.register(LookSource)


def write_frame_index(spark: SparkSession, root: str, path: str, split_bytes: int = SPLIT_BYTES) -> str:
    """Store the index of the files that are longer than ``split_bytes``; returns its path, for option ``index``."""
    large = list_segments(spark, root).where(f"length > {split_bytes}")
    frame_index(large, split_bytes).write.mode("overwrite").parquet(path)
    return path
