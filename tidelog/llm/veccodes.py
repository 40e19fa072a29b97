"""Vector codes: product quantization in whole numbers, over dictionaries of values.

A component becomes the integer floor(4096 * x). Vectors are written once as blocks: per
dimension the distinct integers of the block (its dictionary), and per vector one index into
each. To assign vectors to the entries of a codebook, the squared difference of every
dictionary value to every entry is tabulated, once per value; distances are then gathers of
table rows by index, added up over the dimensions of a part.

A round is one pass over the blocks. Its sums and counts, one row per part and entry, are added
up per task, then by Spark; the driver holds the codebooks only, which are 8 parts of at most
16 entries. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, query
from tidelog.session import cut_lineage

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of a block.
BLOCK = 8192
#: Integers up to this one have squared distances that fit a long, over up to 4096 dimensions.
WIDEST = 1 << 24
_BLOCKS = "ids array<bigint>, labels array<{label}>, sizes array<int>, values array<bigint>, codes binary"

Codebooks = list[list[list[int]]]


def readable(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only, as (vec_id, vec, label)."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"), F.col(label_col).alias("label"))
    return rows.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(4096 * x), exactly: the factor is a power of two."""
    scaled = np.floor(vectors * SCALE)
    if np.abs(scaled).max(initial=0) > WIDEST:
        raise ValueError(f"components beyond {WIDEST // SCALE} have squared distances that fit no long")
    return scaled.astype(np.int64)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """The vectors as blocks with dictionaries, one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), BLOCK):
                batch = whole.slice(start, BLOCK)
                vectors = batch.column(1)
                if any(n != size for n in np.unique(vectors.value_lengths().to_numpy())):
                    raise ValueError(f"vectors of another length than {size}")
                ints = integers(vectors.flatten().to_numpy().reshape(-1, size))
                found = [np.unique(ints[:, d], return_inverse=True) for d in range(size)]
                codes = np.stack([c for _, c in found]).astype("<u2")
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0)), one(batch.column(2)), one(pa.array([len(v) for v, _ in found], pa.int32())),
                     one(pa.array(np.concatenate([v for v, _ in found]))), pa.array([codes.tobytes()], pa.binary())],
                    ["ids", "labels", "sizes", "values", "codes"],
                )

    return rows.mapInArrow(run, _BLOCKS.format(label=dict(rows.dtypes)["label"]))


class _Block:
    """A block as numpy arrays: per dimension its dictionary, and the index of each vector."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids, self.labels = batch.column(0)[row].values, batch.column(1)[row].values
        sizes = batch.column(2)[row].values.to_numpy()
        self.values = np.split(batch.column(3)[row].values.to_numpy(), np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(batch.column(4)[row].as_py(), "<u2").reshape(len(sizes), -1)

    def assign(self, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance to it) of each part and vector; of equal ones the lower entry."""
        width = len(self.values) // len(books)
        nearest, least = [], []
        for p, book in enumerate(books):
            entries = np.array(book, np.int64).reshape(len(book), width)
            distance = np.zeros((self.codes.shape[1], len(book)), np.int64)
            for i in range(width):
                d = p * width + i
                table = (self.values[d][:, None] - entries[:, i]) ** 2
                distance += table[self.codes[d]]
            nearest.append(distance.argmin(axis=1))
            least.append(distance.min(axis=1))
        return np.stack(nearest), np.stack(least)

    def sums(self, part: int, nearest: np.ndarray, entries: int, width: int) -> np.ndarray:
        """Per entry its vectors' count and component sums. Values are weighted by how often they occur."""
        out = np.zeros((entries, 1 + width), np.int64)
        out[:, 0] = np.bincount(nearest, minlength=entries)
        for i in range(width):
            d = part * width + i
            size = len(self.values[d])
            often = np.bincount(nearest * size + self.codes[d], minlength=entries * size).reshape(entries, size)
            out[:, 1 + i] = often @ self.values[d]
        return out


def _totals(blocks: DataFrame, books: Codebooks) -> list:
    """(part, entry, count, sums) of the vectors' parts nearest to each entry."""
    width = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0]), 1 + width), np.int64)
        for batch in batches:
            for row in range(len(batch)):
                block = _Block(batch, row)
                nearest, _ = block.assign(books)
                for p in range(len(books)):
                    total[p] += block.sums(p, nearest[p], len(books[0]), width)
        at = np.argwhere(total[:, :, 0] > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[:, 0]), pa.array(at[:, 1]), *[pa.array(total[at[:, 0], at[:, 1], i]) for i in range(1 + width)]],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]],
        )

    names = ["n", *[f"s{i}" for i in range(width)]]
    found = blocks.mapInArrow(run, ", ".join(f"{n} bigint" for n in ("part", "entry", *names)))
    # At most one row per part and entry.
    return found.groupBy("part", "entry").agg(*[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in names]).collect()


def train(blocks: DataFrame, first: list[list[int]], parts: int, rounds: int) -> Codebooks:
    """Codebooks after ``rounds`` rounds that start from the parts of the vectors ``first``."""
    width = len(first[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        for row in _totals(blocks, books):
            # Entries that no part is nearest to stay.
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(width)]
    return books


def _assigned(blocks: DataFrame, books: Codebooks, label: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = _Block(batch, row)
                nearest, least = block.assign(books)
                raw = np.ascontiguousarray(nearest.T.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [block.ids, pa.array([r.tobytes().hex() for r in raw]), pa.array(least.sum(axis=0)), block.labels], ["vec_id", "code", "error", "label"]
                )

    return blocks.mapInArrow(run, f"vec_id bigint, code string, error bigint, label {label}")


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def vector_codes(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, code, error, label_error) per readable vector, and the codebooks.

    Vectors that are null, empty or hold a null or a number that is not finite are left out.
    Codebooks start as the parts of the vectors with the smallest ids, ties by the vector, null
    ids last; of fewer rows than ``entries`` each gives an entry. Repeated rows count as often as
    they occur. ``label_error`` adds up the errors of equal labels; a null label equals another.
    An empty table gives no row and no codebooks. All vectors must have one length, a multiple of
    ``parts``; another one, or a component beyond 4096, is an error: its distances fit no long."""
    rows = readable(embeddings, id_col, vector_col, label_col)
    start = rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()
    label = dict(rows.dtypes)["label"]
    if not start:
        empty = rows.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, []
    size = len(start[0]["vec"])
    if size % parts or any(len(r["vec"]) != size for r in start):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    blocks = cut_lineage(_blocks(rows, size))
    books = train(blocks, integers(np.array([r["vec"] for r in start])).tolist(), parts, rounds)
    coded = cut_lineage(_assigned(blocks, books, label))
    # Labels are joined by value, nulls apart: one row each, so a hot label is one row on this side.
    per_label = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    known = coded.join(bounded(per_label.where("label is not null")), "label", "left")
    nulls = per_label.where("label is null").select("label_error").first()
    total = F.coalesce(F.col("label_error"), F.lit(None if nulls is None else nulls[0]).cast("long"))
    return known.select("vec_id", "code", "error", total.alias("label_error")), books


def _oracle() -> str:
    """The rounds as a chain of common tables."""
    books = ["b0 AS MATERIALIZED (SELECT part, rank AS entry, v FROM parts WHERE rank < 16)"]
    assign = """(SELECT part, vec_id, v, entry, gap FROM (
      SELECT p.part, p.vec_id, p.v, b.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, b.v)])::BIGINT AS gap,
             row_number() OVER (PARTITION BY p.part, p.vec_id ORDER BY gap, b.entry) AS best
      FROM parts p JOIN {book} b USING (part)) WHERE best = 1)"""
    for r in range(ROUNDS):
        near = assign.format(book=f"b{r}")
        sums = "[" + ", ".join(f"floor(sum(v[{i}]) / count(*))::BIGINT" for i in range(1, 9)) + "]"
        books.append(
            f"b{r + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.v, o.v) AS v FROM b{r} o LEFT JOIN "
            f"(SELECT part, entry, {sums} AS v FROM {near} GROUP BY 1, 2) n USING (part, entry))"
        )
    last = f"b{ROUNDS}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
ranked AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM kept),
parts AS MATERIALIZED (SELECT part, vec_id, rank, v[part * 8 + 1:part * 8 + 8] AS v FROM ranked, range(8) t(part)),
{", ".join(books)},
final AS MATERIALIZED {assign.format(book=last)},
coded AS (
  SELECT vec_id, string_agg('0' || lower(to_base(entry, 16)), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM final GROUP BY 1),
digest AS (SELECT sha256(string_agg(list_aggregate(v, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


@query("op12_vector_codes", _oracle())
def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    return coded.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
