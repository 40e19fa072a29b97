"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most ``d`` bits agree on at least one of ``d + 1`` bit blocks,
so each distinct fingerprint goes to ``d + 1`` buckets, one per block and value. Inside a
bucket the fingerprints are sorted by Gray rank; neighbours then share long bit patterns.
Runs of them become nodes: a mask of the bits on which all members agree, and the pattern
there. Upper nodes factor what their children share. The self-join walks pairs of nodes from
the top, adds up the differing shared bits, and drops a pair, with all that is below it, once
they exceed ``d``.

A bucket reports a forest over its links, never all pairs, so a dense group of near copies
costs one edge per member. Buckets above ``MOST`` are cut into chunks, and every pair of
chunks becomes a bucket of its own: no link is lost and no task holds more than two chunks.
Components follow from alternating star contractions over the edges, each round written to
the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, documents, query
from tidelog.session import cut_lineage

#: Fingerprints of a bucket that one task joins at once.
MOST = 8192
#: Members of a leaf of the index, and children of an upper node.
FAN = 16
SEED = 42
ADDED = ("fingerprint", "component_id")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, fingerprint as a signed long) per row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fold(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


# ---------------------------------------------------------------- index of one bucket


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence: the prefix parity of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(masks, patterns) of the nodes over sorted ``codes``, leaves first, the root last."""
    every, none = codes, codes
    out = []
    while True:
        cuts = np.arange(0, len(every), FAN)
        every, none = np.bitwise_and.reduceat(every, cuts), np.bitwise_or.reduceat(none, cuts)
        out.append((every | ~none, every))
        if len(every) == 1:
            return out


def _spread(parents: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the parent in ``parents``, child) for all children below ``size``."""
    first = parents * FAN
    count = np.minimum(first + FAN, size) - first
    owner = np.repeat(np.arange(len(parents)), count)
    return owner, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _below(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a <= b) of children of the paired nodes."""
    owner, a = _spread(left, size)
    pair, b = _spread(right[owner], size)
    a = a[pair]
    keep = a <= b
    return a[keep], b[keep]


def _close(left: np.ndarray, right: np.ndarray, mask: np.ndarray | None, codes: np.ndarray, distance: int) -> np.ndarray:
    differ = codes[left] ^ codes[right]
    if mask is not None:
        differ &= mask[left] & mask[right]
    return np.bitwise_count(differ) <= distance


def _roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the sets of each pair; the smallest member is the root of all its set."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def join_bucket(codes: np.ndarray, distance: int, side: np.ndarray | None = None) -> np.ndarray:
    """Smallest position linked to each of the distinct ``codes`` (itself if alone).

    Links are pairs of at most ``distance`` differing bits. With ``side``, pairs inside one
    side are some other task's work; links they would add are found there.
    """
    order = np.argsort(gray_rank(codes), kind="stable")
    sorted_codes = codes[order]
    tree = levels(sorted_codes)
    parent = np.arange(len(codes))
    # Depth first in blocks: the frontier of node pairs stays small.
    stack = [(len(tree) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, left, right = stack.pop()
        if len(left) > 4096:
            stack += [(level, left[i : i + 4096], right[i : i + 4096]) for i in range(0, len(left), 4096)]
            continue
        if level == 0:
            left, right = _below(left, right, len(sorted_codes))
            keep = left < right
            if side is not None:
                keep &= side[order][left] != side[order][right]
            left, right = left[keep], right[keep]
            near = _close(left, right, None, sorted_codes, distance)
            parent = _roots(parent, left[near], right[near])
            continue
        mask, pattern = tree[level - 1]
        left, right = _below(left, right, len(pattern))
        near = _close(left, right, mask, pattern, distance)
        if near.any():
            stack.append((level - 1, left[near], right[near]))
    # Back from Gray order; the smallest code's position represents a set.
    out = np.empty(len(codes), np.int64)
    out[order] = order[parent]
    return out


# ---------------------------------------------------------------- all buckets


def block_masks(distance: int) -> list[int]:
    """Masks that cut 64 bits into ``distance + 1`` blocks of nearly equal width."""
    parts = distance + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(codes: DataFrame, distance: int, most: int = MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all links at ``distance``."""
    blocks = F.array(*[
        F.struct(F.lit(i).cast("short").alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(block_masks(distance))
    ])
    spread = codes.select("fp", F.inline(blocks))
    hot = cut_lineage(
        spread.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > most)
        .select("block", "value", F.ceil(2 * F.col("n") / most).cast("int").alias("chunks"))
    )
    home = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    spread = (
        spread.join(bounded(hot), ["block", "value"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("home", home)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "block", "value", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"),
            (F.col("home") > F.col("other")).alias("side"), "fp",
        )
    )
    key = ["block", "value", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _starts(table, key)
            if len(starts) > 1:
                yield _edges(table.slice(0, starts[-1]), starts[:-1], distance)
            held = table.slice(starts[-1])
        if held is not None and len(held):
            yield _edges(held, np.zeros(1, np.int64), distance)

    return spread.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(run, "a long, b long")


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where each bucket of a sorted table begins."""
    change = np.zeros(len(table), bool)
    change[:1] = True
    for name in key:
        values = table[name].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _edges(table: pa.Table, starts: np.ndarray, distance: int) -> pa.RecordBatch:
    codes = table["fp"].to_numpy().view(np.uint64)
    side = table["side"].to_numpy(zero_copy_only=False)
    across = table["low"].to_numpy() != table["high"].to_numpy()
    found = []
    ends = np.append(starts[1:], len(table))
    for start, end in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
        bucket = codes[start:end]
        if end - start == 2:
            if int(bucket[0] ^ bucket[1]).bit_count() <= distance:
                found.append((start, start + 1))
            continue
        root = join_bucket(bucket, distance, side[start:end] if across[start] else None)
        found += [(start + int(r), start + i) for i, r in enumerate(root) if r != i]
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    signed = codes.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    Large-star and small-star rounds alternate until nothing moves. Each is an aggregate for the
    smallest neighbour (map-side combined, so a hub is one row per task) and a join back.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    )
    before = state(edges)
    while True:
        around = both(edges)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, distance: int = 4, most: int = MOST
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Ids must be integers. Fingerprints link at ``distance`` or fewer differing bits; a component
    is named after its smallest id. A null or empty text has fingerprint zero and links like any
    other. Rows with a null id take part, but never name a component unless it has no other id;
    then it is null. Repeated rows are repeated. An empty table gives an empty table.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    codes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    roots = components(links(codes.select("fp"), distance, most))
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    labels = named.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with its columns.

    Rows without an id stay, and rows that repeat the id that stays all stay."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = cut_lineage(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct())
    return docs.join(bounded(gone), id_col, "left_anti").select(*docs.columns)


@query("op10_simhash_gray_index")
def op10_simhash_gray_index(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
