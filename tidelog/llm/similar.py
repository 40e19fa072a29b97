"""Near copies by the words themselves: documents whose sets of five-word shingles overlap by 0.8 or more.

Similarity is exact (Jaccard of the sets of 64-bit shingle hashes, in whole numbers). First
links come from the Gray-order index over SimHash fingerprints, each confirmed on the sets. A
fingerprint alone misses most pairs near the bound, so prefixes of the sets supply the rest:
two sets with that overlap share one of their first n - ceil(0.8 n) + 1 shingles, in whatever
order all sets are sorted, and with m shingles more at least m + 1. Longer prefixes by hash
value sieve out documents that can have no near copy, since too few of theirs stand in any
other prefix; for the rest the order is rarest first, so passages that many documents share come
last and rarely name a pair.

Dense groups stay cheap: the index reports a forest, and every shared shingle a star. Only
shingles whose documents are still in different components have their sets compared: a set as the
smaller one of a pair by the first ninth of its shingles, as the larger one by the first fifth. A
pair goes on only if the shingles after the shared one can still make up the overlap and sketches
of both sets do not rule it out. A passage that many documents share comes last in their order,
so what passes is nearly alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, release
from tidelog.llm.simhash import MOST, SEED, _starts, components, fold, links, shingle_hashes
from tidelog.session import cut_lineage

SHINGLE = 5
#: Differing bits of the links that the index proposes.
DISTANCE = 4
#: Bits of a set's sketch.
SKETCH = 512
#: Texts whose hashes, or sets whose comparisons, a task holds at once.
SLICE = 512


def needed(n: int) -> int:
    """Shingles that a set of ``n`` shares with any set it overlaps by 0.8."""
    return (4 * n + 4) // 5


def head(n: int) -> int:
    """Length of the prefix of ``n`` shingles of which two similar sets share one or more."""
    return n - needed(n) + 1


def extra(n: int) -> int:
    """Shared shingles that the sieve's longer prefix, of ``head(n) + extra(n) - 1``, asks for."""
    return max(1, head(n) // 2)


def sketch(own: np.ndarray) -> list[int]:
    """Per value of ``SKETCH`` low bits whether the set holds an odd number of such hashes, as longs.

    Two sketches differ in no more bits than their sets differ in elements."""
    odd = np.bincount(own.astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def _hashed(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Per row: id, ``node`` (names the set), ``n``, ``fp``, ``least``, ``hashes``: the set, or the sieve's prefix, of which
    ``least`` or more stand in the prefix of any similar set (whose size is ``needed(n)`` or more); ``sketch`` of a whole set."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole_.slice(at, SLICE) for whole_ in batches for at in range(0, len(whole_), SLICE)):
            nodes, sizes, prints, parts, sketches = [], [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), SHINGLE)
                own = np.unique(hashes)
                nodes.append(xxhash.xxh3_128_hexdigest(own.astype("<u8").tobytes(), SEED))
                sizes.append(len(own))
                prints.append(fold(hashes))
                sketches.append(sketch(own) if whole else None)
                parts.append((own if whole else own[: head(len(own)) + extra(len(own)) - 1].copy()).view(np.int64))
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            flat = np.concatenate([*parts, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.string()), pa.array(sizes, pa.int32()),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array([extra(needed(n)) for n in sizes], pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "fp", "least", "hashes", "sketch"],
            )
        release()

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, node string, n int, fp long, least int, hashes array<long>, sketch array<long>")


def _may_fit(n: Column, rest: Column, other_n: Column, other_rest: Column) -> Column:
    """Whether sets of these sizes can overlap by 0.8 if they share a shingle from which on each has so many others to share."""
    return 9 * F.least(rest, other_rest) >= 4 * (n + other_n)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets overlap by 0.8 or more."""
    side = lambda x: sets.select(F.col("k").alias(x), F.col("hashes").alias(f"{x}_set"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return cut_lineage(
        bounded(cut_lineage(pairs)).join(side("a"), "a").join(side("b"), "b").where(9 * shared >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b")
    )


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _partners(open_: DataFrame, most: int) -> DataFrame:
    """(a, bs): per shingle and set, which larger sets of other components might overlap with it by 0.8.

    The sets of a shingle are compared in numpy, a slice against all. Those of a shingle that over
    ``most`` sets share are cut into chunks, and each pair of chunks meets in a task of its own."""
    crowd = open_.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > most)
    crowd = cut_lineage(crowd.select("h", F.ceil(2 * F.col("m") / most).cast("int").alias("chunks")))
    rows = open_.join(bounded(crowd), "h", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    home = F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int")
    rows = rows.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "h", F.least("home", "other").alias("low"), F.greatest("home", "other").alias("high"), (F.col("home") > F.col("other")).alias("side"),
        "k", "n", "rest", "short", "root", "sketch",
    )
    key = ["h", "low", "high"]

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, n, rest, root = (table[c].to_numpy().astype(np.int64) for c in ("k", "n", "rest", "root"))
        side, short = (table[c].to_numpy() for c in ("side", "short"))
        words = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(k), -1)
        across = table["low"][0].as_py() != table["high"][0].as_py()
        for at in range(0, len(k), SLICE):
            rows = np.flatnonzero(short[at : at + SLICE]) + at
            fits = (root[rows, None] != root) & (9 * np.minimum(rest[rows, None], rest) >= 4 * (n[rows, None] + n))
            fits &= (n[rows, None] < n) | ((n[rows, None] == n) & (k[rows, None] < k))
            if across:
                fits &= side[rows, None] != side
            a, b = np.nonzero(fits)
            near = np.zeros(len(a), bool)
            for start in range(0, len(a), 1 << 18):
                part = slice(start, start + (1 << 18))
                differ = np.bitwise_count(words[rows[a[part]]] ^ words[b[part]]).sum(axis=1, dtype=np.int64)
                # Sets that overlap by 0.8 differ in a ninth of their sizes at most.
                near[part] = 9 * differ <= n[rows[a[part]]] + n[b[part]]
            a, b = rows[a[near]], b[near]
            if len(a):
                cuts = np.flatnonzero(np.diff(a, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[a[cuts]]), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(a)).astype(np.int32)), pa.array(k[b]))], ["a", "bs"]
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            starts = _starts(table, key)
            for start, end in zip(starts[:-1], starts[1:]):
                yield from compared(table.slice(start, end - start))
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None and len(held):
            yield from compared(held)

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, bs array<long>")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id and ``component_id``, the smallest id reachable over links.

    Texts of fewer than five words are one shingle. Null and blank texts have no shingle and
    link to one another. Null ids take part as in ``simhash.near_duplicates``.
    """
    # Numbers are short names of rows: written, so that they stay.
    rows = cut_lineage(_hashed(docs, id_col, text_col, whole=False).withColumn("k", F.monotonically_increasing_id()))

    # What can have a near copy at all, by prefixes in the order of the hash values.
    heads = rows.select("k", "least", F.explode("hashes").alias("h"))
    # Low bits are enough to sieve: values that clash only let more rows through.
    heads = heads.withColumn("h", F.col("h").bitwiseAND(F.lit((1 << 40) - 1)))
    twice = cut_lineage(heads.groupBy("h").agg(F.count("*").alias("df")).where("df > 1").select("h"))
    # Plain joins here, so that tables of any size take the same way.
    some = heads.join(twice, "h", "left_semi").groupBy("k", "least").agg(F.count("*").alias("met")).where("met >= least")
    ids = rows.join(bounded(cut_lineage(some.select("k"))), "k", "left_semi").select(F.col("doc_id").alias(id_col)).distinct()
    ids = cut_lineage(ids.where(F.col(id_col).isNotNull()))
    asked = docs.select(id_col, text_col).join(bounded(ids), id_col, "left_semi")
    asked = asked.unionByName(docs.where(F.col(id_col).isNull()).select(id_col, text_col))
    full = cut_lineage(_hashed(asked, id_col, text_col, whole=True).withColumn("k", F.monotonically_increasing_id()))
    # Equal sets are one.
    nodes = cut_lineage(full.groupBy("node").agg(F.min("k").alias("k"), F.min("fp").alias("fp")))
    sets = full.join(bounded(nodes.select("k")), "k", "left_semi").select("k", "n", "hashes")

    # Their prefixes with the rarest shingles first. Those that stand in one set only come before all others.
    each = sets.select("k", "n", F.explode("hashes").alias("h"))
    common = cut_lineage(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    shared = each.join(common, "h").groupBy("k", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("in_order"))
    # From a shared shingle on, ``rest`` of a set's shingles stand in other sets at all: if it is the first
    # that two sets share, they share ``rest`` at most. ``short`` marks what the smaller of two sets needs.
    keys = shared.select("k", "n", F.size("in_order").alias("left"), F.posexplode("in_order").alias("at", "s"))
    keys = keys.select("k", "n", "s.h", (F.col("left") - F.col("at")).alias("rest")).where("5 * rest >= 4 * n")
    keys = cut_lineage(keys.withColumn("short", F.expr("9 * rest >= 8 * n")))

    # The index's forest and a star per shingle, confirmed.
    low = cut_lineage(nodes.groupBy("fp").agg(F.min("k").alias("low")))
    named = lambda x: low.select(F.col("fp").alias(x), F.col("low").alias(f"{x}_k"))
    index = links(low.select("fp"), DISTANCE).distinct().join(named("a"), "a").join(named("b"), "b")
    same = nodes.join(low, "fp")
    centre = keys.where("short").groupBy("h").agg(F.min(F.struct("k", "n", "rest")).alias("c"))
    star = keys.join(centre, "h").where(_may_fit(F.col("n"), F.col("rest"), F.col("c.n"), F.col("c.rest")))
    first = cut_lineage(
        index.select(*_pairs(F.col("a_k"), F.col("b_k")))
        .unionByName(same.select(*_pairs(F.col("k"), F.col("low"))))
        .unionByName(star.select(*_pairs(F.col("k"), F.col("c.k"))))
        .where("a != b").distinct()
    )
    edges = _confirmed(first, sets)
    roots = components(edges).withColumnRenamed("node", "k")

    # What a star left apart: pairs of a smaller set and a larger one by their first shared shingle.
    placed = cut_lineage(keys.join(roots, "k", "left").select("h", "k", "n", "rest", "short", F.coalesce("root", "k").alias("root")))
    split = placed.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("short").alias("some")).where("some and r0 != r1").select("h")
    open_ = cut_lineage(placed.join(bounded(cut_lineage(split)), "h", "left_semi").join(full.select("k", "sketch"), "k"))
    # Partners of a set as one list per shingle; a pair that shares many shingles is one row in the end.
    partners = _partners(open_, most).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    rest = partners.select("a", F.explode("bs").alias("b")).select(*_pairs(F.col("a"), F.col("b")))
    rest = rest.join(first, ["a", "b"], "left_anti")
    more = _confirmed(rest, sets)
    if not more.isEmpty():
        roots = components(edges.unionByName(more)).withColumnRenamed("node", "k")

    placed = nodes.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    # Ids come from all rows. A set that was sieved out is a component alone, with all rows that hold it.
    alone = rows.groupBy("node").agg(F.min("doc_id").alias("own_id"))
    named = cut_lineage(alone.join(placed.select("node", "root"), "node", "left"))
    lowest = named.where("root is not null").groupBy("root").agg(F.min("own_id").alias("component_id"))
    labels = named.join(lowest, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("own_id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.select("doc_id", "node").join(labels, "node").select(F.col("doc_id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id, with its columns.

    Rows without an id stay, and rows that repeat the id that stays all stay."""
    found = similar_components(docs, id_col, text_col)
    gone = cut_lineage(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct())
    return docs.join(bounded(gone), id_col, "left_anti").select(*docs.columns)
