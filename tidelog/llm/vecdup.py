"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one class with a weight. A table cuts the space by ``bits`` random planes; the
side of each gives a bucket. ``bits`` follows from the number of vectors, so that buckets stay
near ``OCCUPANCY``, and the number of tables from ``bits``, so that a pair right at the bound meets
in some table with probability ``RECALL``. A bucket multiplies its vectors out, counts links and
reports a forest over them: one row per member, never a list of pairs. A pair that meets in
several tables counts in the first only, which the signatures of both show.

Dense groups. In a bucket of over ``MOST`` vectors, those within half of the bound's angle of the
bucket's mean direction are a clique: any two of them link, by the triangle inequality of angles.
Their links are counted from the clique's weight alone, and they are never compared with one
another; in the bucket they meet only the others. What is left is cut into chunks of ``MOST``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, query
from tidelog.llm.simhash import _roots, _starts, components
from tidelog.session import cut_lineage

LEAST = 0.9
RECALL = 0.99
#: Vectors of a bucket, on average, if they lie evenly.
OCCUPANCY = 1024
#: Vectors of a bucket, or of a chunk of one, that a task compares with one another.
MOST = 4096
#: Rows whose cosines with a bucket are held at once.
ROWS = 512
SEED = 42
#: Mean directions that may be broadcast: 10 MB at 64 dimensions.
MEANS = 20_000


def layout(n: int, least: float, recall: float, occupancy: int) -> tuple[int, int]:
    """(tables, bits of each) for ``n`` vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / occupancy))))
    meets = (1 - math.acos(least) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meets)), bits


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of one length as rows of doubles, scaled to a largest component of 1."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return out / np.abs(out).max(axis=1, keepdims=True)


def _units(column: pa.Array, size: int) -> np.ndarray:
    out = _matrix(column, size)
    return out / np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]


def _by_length(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(vector).value_lengths().to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def _signed(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """``classes`` with ``signs``: per table the sides of its planes, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for size, part in _by_length(batch, batch.schema.get_field_index("vec")):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, tables * bits))
                sides = _matrix(part.column("vec"), size) @ planes[size] >= 0
                signs = (sides.reshape(-1, tables, bits) @ weights).astype(np.int32)
                ends = np.arange(0, signs.size + 1, tables, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(signs.ravel()))], [*part.schema.names, "signs"]
                )

    return classes.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in classes.dtypes) + ", signs array<int>")


_BUCKET = ["size", "t", "sign"]


def _cliques(members: DataFrame, angle: float) -> DataFrame:
    """(k, clique): vectors of crowded buckets that lie within half of ``angle`` of a bucket's mean direction."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_length(batch, batch.schema.get_field_index("vec")):
                units = _units(part.column("vec"), size)
                keys = np.stack([part.column("t").to_numpy(), part.column("sign").to_numpy()])
                found, at = np.unique(keys, axis=1, return_inverse=True)
                total = np.zeros((found.shape[1], size))
                np.add.at(total, at.ravel(), units)
                one = found.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(one * size, size, np.int32)), pa.array(np.repeat(found[0], size).astype(np.int32)),
                     pa.array(np.repeat(found[1], size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), one)), pa.array(total.ravel())],
                    [*_BUCKET, "d", "x"],
                )

    means = members.select(*_BUCKET, "vec").mapInArrow(sums, "size int, t int, sign int, d int, x double")
    means = means.groupBy(*_BUCKET, "d").agg(F.sum("x").alias("x")).groupBy(*_BUCKET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean")
    )
    # A margin far above rounding: what lies on the edge is compared pair by pair.
    near = math.cos(angle / 2 - 1e-6)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    close = dot(F.col("vec"), F.col("mean")) >= near * F.sqrt(dot(F.col("vec"), F.col("vec"))) * F.sqrt(dot(F.col("mean"), F.col("mean")))
    largest = F.array_max(F.transform("vec", F.abs)).cast("double")
    scaled = members.withColumn("vec", F.transform("vec", lambda x: x / largest))
    found = scaled.join(bounded(cut_lineage(means), MEANS), _BUCKET).where(close)
    return cut_lineage(found.groupBy("k").agg(F.min(F.struct(*_BUCKET)).alias("clique")))


def _spread(each: DataFrame, most: int) -> DataFrame:
    """Rows of all buckets with ``kind``, ``low``, ``high`` and ``side``: bucket or chunk to meet in.

    ``each`` has a row per vector and table. Kind 0: all compare, or, if ``low`` and ``high`` differ,
    those of one side with those of the other. Kind 1: members of the bucket's main clique (side
    true) compare with the others."""
    crowd = each.groupBy(*_BUCKET, "clique").agg(F.count("*").alias("n"))
    crowd = crowd.groupBy(*_BUCKET).agg(F.sum("n").alias("n"), F.max(F.when(F.col("clique").isNotNull(), F.struct("n", "clique"))).alias("main"))
    rest = F.col("n") - F.coalesce(F.col("main.n"), F.lit(0))
    crowd = crowd.where(F.col("n") > most).select(
        *_BUCKET, F.col("main.clique").alias("main"), F.ceil(F.col("main.n") / most).cast("int").alias("cliques"),
        F.ceil(rest / most).cast("int").alias("others"), F.ceil(2 * rest / most).cast("int").alias("chunks"),
    )
    rows = each.join(bounded(cut_lineage(crowd)), _BUCKET, "left")
    home = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, low, high, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"), side.alias("side"))
    inside = F.transform(upto("others"), lambda o: place(1, home("cliques"), o, F.lit(True)))
    across = F.transform(F.when(F.col("main").isNotNull(), upto("cliques")).otherwise(F.array().cast("array<int>")), lambda c: place(1, c, home("others"), F.lit(False)))
    among = F.transform(upto("chunks"), lambda o: place(0, F.least(home("chunks"), o), F.greatest(home("chunks"), o), home("chunks") > o))
    places = (
        F.when(F.col("chunks").isNull(), F.array(place(0, F.lit(0), F.lit(0), F.lit(False))))
        .when(F.coalesce(F.col("clique") == F.col("main"), F.lit(False)), inside).otherwise(F.concat(across, among))
    )
    return rows.select(*_BUCKET, F.inline(places), "k", "weight", F.xxhash64("clique").alias("clique"), F.col("clique").isNotNull().alias("in_clique"), "signs", "vec")


def _linked(table: pa.Table, tables: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of a bucket's vectors: weight of those that each links with here for the
    first time, and the position of the smallest one reachable over links."""
    n = len(table)
    size, t, kind = (table[c][0].as_py() for c in ("size", "t", "kind"))
    across = kind == 1 or table["low"][0].as_py() != table["high"][0].as_py()
    units = _units(table["vec"].combine_chunks(), size)
    weight = table["weight"].to_numpy()
    side = table["side"].to_numpy()
    clique = np.where(table["in_clique"].to_numpy(), table["clique"].to_numpy(), 0)
    signs = table["signs"].combine_chunks().flatten().to_numpy().reshape(n, tables)
    links, parent = np.zeros(n, np.int64), np.arange(n)
    for start in range(0, n, ROWS):
        rows = slice(start, min(n, start + ROWS))
        near = units[rows] @ units.T >= least
        near[np.arange(rows.stop - start), np.arange(start, rows.stop)] = False
        if across:
            near &= side[rows, None] != side
        if clique.any():
            near &= (clique[rows, None] != clique) | (clique[rows, None] == 0)
        if not near.any():
            continue
        a, b = np.nonzero(near)
        parent = _roots(parent, a + start, b)
        # Only pairs that met in no earlier table.
        for before in range(t):
            near &= signs[rows, before, None] != signs[:, before]
        links[rows] = near @ weight
    return links, parent


def _bucket_links(spread: DataFrame, tables: int, least: float) -> DataFrame:
    """(a, b, links): a vector's links found in one bucket, and the smallest vector there it is linked to."""
    key = [*_BUCKET, "kind", "low", "high"]

    def edges(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        found = []
        for start, end in zip(starts, np.append(starts[1:], len(table))):
            if end - start > 1:
                bucket = table.slice(start, end - start)
                links, root = _linked(bucket, tables, least)
                k = bucket["k"].to_numpy()
                at = np.flatnonzero((links > 0) | (root != np.arange(len(k))))
                found.append(np.stack([k[at], k[root[at]], links[at]]))
        a, b, links = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _starts(table, key)
            if len(starts) > 1:
                yield edges(table.slice(0, starts[-1]), starts[:-1])
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None and len(held):
            yield edges(held, np.zeros(1, np.int64))

    return spread.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, links long")


def near_vectors(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    *, least: float = LEAST, recall: float = RECALL, occupancy: int = OCCUPANCY, most: int = MOST, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, ``n_links``, ``component_id``, ``kept``.

    Vectors link at a cosine of ``least`` or more, in double precision, whatever their labels;
    a pair right at the bound is found with probability ``recall``, closer ones more surely, and
    none below it links. Vectors that are null, empty or zero, or hold a null or a number that is
    not finite, link with nothing, and so do vectors of different lengths. Repeated rows are other
    vectors and link. A component is named after its smallest id; null ids name it only if it has
    no other (then null), and are kept only there. An empty table gives an empty table."""
    vec = F.col(vector_col)
    fine = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.coalesce(fine, F.lit(False)).alias("fine"))
    named = rows.withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    usable = named.where("fine")
    n = usable.count()
    tables, bits = layout(n, least, recall, occupancy)
    classes = usable.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    # Numbers are short names of vectors: written, so that they stay.
    signed = cut_lineage(_signed(classes.withColumn("size", F.size("vec")), tables, bits, seed).withColumn("k", F.monotonically_increasing_id()))

    each = signed.select("k", "size", "weight", "vec", "signs", F.posexplode("signs").alias("t", "sign"))
    crowded = cut_lineage(each.groupBy(*_BUCKET).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*_BUCKET))
    if crowded.isEmpty():
        cliques = None
        each = each.withColumn("clique", F.lit(None).cast("struct<size:int,t:int,sign:int>"))
    else:
        cliques = _cliques(each.join(bounded(crowded), _BUCKET, "left_semi"), math.acos(least))
        each = each.join(bounded(cliques), "k", "left")
    found = cut_lineage(_bucket_links(_spread(each, most), tables, least))

    counts, edges = found.select(F.col("a").alias("k"), "links"), found.select("a", "b")
    if cliques is not None:
        whole = cliques.join(signed.select("k", "weight"), "k")
        about = cut_lineage(whole.groupBy("clique").agg(F.sum("weight").alias("total"), F.min("k").alias("first")))
        whole = whole.join(bounded(about), "clique")
        counts = counts.unionByName(whole.select("k", (F.col("total") - F.col("weight")).alias("links")))
        edges = edges.unionByName(whole.select(F.col("k").alias("a"), F.col("first").alias("b")))
    counts = counts.groupBy("k").agg(F.sum("links").alias("links"))
    roots = components(edges.where("a != b")).withColumnRenamed("node", "k")
    placed = signed.select("k", "h1", "h2", "weight", "low").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = placed.join(counts, "k", "left").join(lowest, "root").select(
        "h1", "h2", F.lit(True).alias("fine"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    out = named.select("vec_id", "h1", "h2", "fine").join(labels, ["h1", "h2", "fine"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


@query("op13_near_vectors")
def op13_near_vectors(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
