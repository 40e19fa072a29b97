"""Conversation prefix trie: which conversations start alike, and what sharing their prefixes saves.

A turn becomes an id (a digest of its role and text), and a conversation a row of positional
turn-id columns. ``ROLLUP`` over those columns aggregates all prefixes at once; ``grouping_id``
tells the depth. A conversation longer than one block of columns goes on in further rows, one
per block, each keyed by the node that the block before it ended at. Nodes are named by sums of
digests that include the position, so the key of any block follows from a running sum and all
blocks of all lengths go through one rollup.

Sums over subtrees are a second rollup, over the nodes. What hangs below a block's last column
is added first: by pointer doubling over the ends of blocks, in log2(blocks) rounds.

Nothing puts a conversation or a node's members into one task: turns are numbered by a range
sort, block keys by sums over groups of blocks, and member lists are hashed as a stream of
blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, query
from tidelog.session import cut_lineage

#: Positional columns of one rollup.
WIDTH = 8
#: Blocks of a conversation whose keys one task adds up.
GROUP_BITS = 10
#: Ids of a node's members that are joined to one string.
ID_BITS = 12
#: Turns of a conversation that other conversations may begin with.
HEAD = 5

_LANES = ("a", "b", "c", "d")
_KEY = "struct<a:bigint,b:bigint,c:bigint,d:bigint>"


def _lanes(digest: Column) -> Column:
    """Four 32-bit numbers of a SHA-256 digest in hex; sums of 2**31 of them fit a long."""
    return F.struct(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(n) for i, n in enumerate(_LANES)])


def _added(*keys: Column) -> Column:
    """The key that the given keys add up to; null ones count as zero."""
    part = lambda n: reduce(lambda x, y: x + y, [F.coalesce(k[n], F.lit(0).cast("long")) for k in keys])
    return F.struct(*[part(n).alias(n) for n in _LANES])


def _numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``n``, the place in the conversation from 1.

    Rows are sorted by range, so a long conversation spans tasks. Only places inside one
    range's share of a conversation are counted in a window; the few conversations that span
    ranges get the counts of their earlier shares added."""
    order = ["conv_id", "turn", "digest"]
    dealt = cut_lineage(turns.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).withColumn("share", F.spark_partition_id()))
    shares = cut_lineage(dealt.groupBy("conv_id", "share").agg(F.count("*").alias("rows")))
    spanning = shares.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    # A range has two ends, so there are at most two such rows a range.
    start = shares.join(bounded(cut_lineage(spanning)), "conv_id", "left_semi").select(
        "conv_id", "share", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("conv_id", "share").orderBy(F.asc_nulls_first("turn"), "digest")
    counted = dealt.withColumn("n", F.row_number().over(inside).cast("long"))
    return counted.join(bounded(cut_lineage(start)), ["conv_id", "share"], "left").select(
        "conv_id", "digest", "length", (F.col("n") + F.coalesce("start", F.lit(0))).alias("n")
    )


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, length): turns in order, a digest of role and text, code points of the text.

    Turns are ordered by ``turn``, null first; equal ones by their digest, so repeated rows are
    turns that repeat. Null roles and texts are empty. Rows without a conv_id are in no
    conversation and are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length tells where the role ends.
    digest = F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256)
    return _numbered(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
            digest.alias("digest"), F.char_length(text).alias("length"),
        )
    )


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Conversation c as the first h turns of conversation ``c - c % 100`` and then its own after
    its first h, h the CRC-32 of c's decimal form modulo 6. Adds ``size``, its turns after that.

    A conversation that is left without turns has one row whose ``n`` is 0."""
    heads = turns.where((F.col("n") <= HEAD) & (F.col("conv_id") % 100 == 0)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("n", "digest", "length"))).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100})
    begun = sizes.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.expr("array()")), F.lit(1), F.col("h")))
    begun = cut_lineage(begun.withColumn("size", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    first = begun.where("size(head) > 0").select("conv_id", "size", F.inline("head"))
    rest = turns.join(begun.select("conv_id", "h", "size", F.size("head").alias("got")), "conv_id").where("n > h")
    bare = begun.where("size = 0").select("conv_id", "size", F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), F.lit(0).alias("length"))
    columns = ["conv_id", "size", "n", "digest", "length"]
    return (
        first.select(columns)
        .unionByName(rest.withColumn("n", F.col("n") - F.col("h") + F.col("got")).select(columns))
        .unionByName(bare)
    )


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block of columns: ``block``, ``prior`` (key of the node that
    the block before ended at), ``t1`` .. ``t<width>`` (key and length, null beyond the end),
    ``last`` (whether the conversation ends in it)."""
    at = F.greatest(F.col("n") - 1, F.lit(0).cast("long"))
    place = F.sha2(F.concat(F.col("n").cast("string"), F.lit(":"), F.col("digest")), 256)
    turn = F.struct((at % width).alias("slot"), _lanes(place).alias("key"), F.col("length"))
    rows = turns.withColumns({"block": F.expr(f"cast(greatest(n - 1, 0) div {width} as long)"), "turn": F.when(F.col("n") > 0, turn)})
    # At most ``width`` turns meet in a row.
    rows = cut_lineage(
        rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.max("size").alias("size"))
    )
    # Keys of the blocks before: sums over whole groups of blocks first, then inside a group.
    part = lambda n: F.expr(f"aggregate(turns, 0L, (s, x) -> s + x.key.{n})")
    own = rows.where(F.col("size") > width).select(
        "conv_id", "block", F.shiftright("block", GROUP_BITS).alias("group"), *[part(n).alias(n) for n in _LANES]
    )
    up = Window.partitionBy("conv_id").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = own.groupBy("conv_id", "group").agg(*[F.sum(n).alias(n) for n in _LANES])
    groups = groups.select("conv_id", "group", *[F.coalesce(F.sum(n).over(up), F.lit(0)).alias(f"up_{n}") for n in _LANES])
    down = Window.partitionBy("conv_id", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keys = own.withColumns({n: F.coalesce(F.sum(n).over(down), F.lit(0)) for n in _LANES}).join(groups, ["conv_id", "group"])
    keys = keys.select("conv_id", "block", F.struct(*[(F.col(n) + F.col(f"up_{n}")).alias(n) for n in _LANES]).alias("prior"))
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in _LANES])
    return rows.join(keys, ["conv_id", "block"], "left").select(
        "conv_id", "block", F.coalesce("prior", zero).alias("prior"),
        *[F.when(F.size("turns") > i, F.struct(F.col("turns")[i]["key"].alias("key"), F.col("turns")[i]["length"].alias("length"))).alias(f"t{i + 1}") for i in range(width)],
        (F.col("block") == F.expr(f"greatest(size - 1, 0) div {width}")).alias("last"),
    )


def _columns(width: int) -> list[str]:
    return [f"t{i + 1}" for i in range(width)]


def _key(width: int) -> Column:
    """Key of the node that a row's block and columns lead to."""
    return _added(F.col("prior"), *[F.col(t)["key"] for t in _columns(width)])


def _prefixes(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """``ROLLUP`` over the columns: one row per block, prior node and prefix, with ``level``, its length in the block."""
    columns = ", ".join(_columns(width))
    found = rows.sparkSession.sql(
        f"SELECT block, prior, {columns}, {width} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{rows}} GROUP BY block, prior, ROLLUP({columns})",
        rows=rows,
    )
    # A rollup also makes groups of rows that had ended already; those are nodes of a lower level.
    there = reduce(lambda out, i: out.when(F.col("level") == i, F.col(f"t{i}").isNotNull()), range(2, width + 1), F.when(F.col("level") == 1, F.col("t1").isNotNull()))
    # The textless prefix of a later block is a node of the block before.
    return found.where(there.otherwise(F.col("block") == 0))


def _nodes(blocks: DataFrame, width: int) -> DataFrame:
    """One row per node: its block, columns and ``level``, ``key``, ``parent`` key, ``conv_id``, ``n_convs``, ``weight`` (what sharing its last turn saves)."""
    found = _prefixes(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs")
    newest = F.coalesce(*[F.col(t) for t in reversed(_columns(width))])
    key = _key(width)
    parent = F.struct(*[(F.col("key")[n] - newest["key"][n]).alias(n) for n in _LANES])
    return cut_lineage(
        found.withColumn("key", key).withColumns({
            "parent": F.when(F.col("level") > 0, parent),
            "weight": F.coalesce((F.col("n_convs") - 1) * newest["length"], F.lit(0).cast("long")),
        })
    )


def _below_blocks(nodes: DataFrame, width: int) -> DataFrame:
    """(key, leaves, saved) of every node that further blocks begin at: sums over those blocks
    and all blocks below them."""
    within = cut_lineage(nodes.where("block > 0").groupBy(F.col("prior").alias("key")).agg(F.sum("leaf").alias("leaves"), F.sum("weight").alias("saved")))
    # The block that a block's first node lies in begins at another such node, or at the root.
    ends = nodes.where(F.col("level") == width).select("key", F.when(F.col("block") > 0, F.col("prior")).alias("up"))
    state = cut_lineage(within.join(ends, "key"))
    while not state.where("up is not null").isEmpty():
        given = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select(F.col("key").alias("up"), F.col("up").alias("far"))
        state = cut_lineage(
            state.join(given, "key", "left").join(above, "up", "left").select(
                "key", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("far").alias("up"),
            )
        )
    return state.select("key", "leaves", "saved")


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) over the ids, ascending and comma-joined, of the conversations that end at a node.

    Ids are joined to strings in blocks of ids, and a node's strings pass one task in order."""
    packed = ends.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("at")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    named = packed.select(
        F.concat_ws(",", *[F.col("key")[n].cast("string") for n in _LANES]).alias("name"), "at", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, digests = [], []
            for this, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if this != name:
                    if name is not None:
                        names.append(name)
                        digests.append(state.hexdigest())
                    name, state = this, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    hashed = named.repartition("name").sortWithinPartitions("name", "at").mapInArrow(run, "name string, ends_sha256 string")
    lanes = F.split("name", ",")
    return hashed.select(F.struct(*[lanes[i].cast("long").alias(n) for i, n in enumerate(_LANES)]).alias("key"), "ends_sha256")


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """The trie of conversations given as (conv_id, size, n, digest, length), see ``with_shared_heads``.

    One row per distinct prefix: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. No conversation, no row."""
    blocks = cut_lineage(_blocks(turns, width))
    nodes = _nodes(blocks, width)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    own = nodes.select("key", "block", "prior", *_columns(width), "level", "conv_id", "parent", "n_convs", "weight")
    nodes = cut_lineage(
        own.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    )
    below = _below_blocks(nodes, width)
    heavy = nodes.join(below.select("key", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved")), "key", "left")
    heavy = heavy.select(
        "block", "prior", *_columns(width), (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("weight") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    sums = _prefixes(heavy, width, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
    sums = sums.select(_key(width).alias("key"), "n_leaves", "saved_tokens")
    ends = _member_hashes(blocks.where("last").select(_key(width).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    facts = nodes.select("key", "parent", "conv_id", (F.col("block") * width + F.col("level")).alias("depth"), "n_convs", "n_children")
    return (
        facts.join(sums, "key").join(ends, "key", "left").join(parents, "parent", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


#: CRC-32 of a decimal number: the reflected polynomial, bit by bit.
_CRC = (
    "xor(list_reduce([4294967295::BIGINT] || [ord(x)::BIGINT FOR x IN string_split(c::VARCHAR, '')], lambda s, x: "
    "list_reduce([xor(s, x)] || [0::BIGINT FOR i IN range(8)], lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT)"
)
ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS n, role, text, d
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY n) AS t FROM turns GROUP BY c),
crc AS (SELECT c, t, {_CRC} % 6 AS h FROM own),
rebuilt AS (
  SELECT a.c, coalesce(b.t[1:a.h], []) || a.t[a.h + 1:] AS t
  FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (SELECT c, unnest(range(len(t) + 1)) AS d, t FROM rebuilt),
nodes AS (
  SELECT d, t[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(t) = d), '') AS ends
  FROM prefixes GROUP BY 1, 2),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
whole AS (
  SELECT x.*, coalesce(n, 0) AS n_children, CASE WHEN x.d > 0 THEN (n_convs - 1) * length(x.p[x.d].text) ELSE 0 END AS w
  FROM nodes x LEFT JOIN children y ON x.d = y.d AND x.p = y.p),
sums AS (
  SELECT u AS d, p[1:u] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum(w) AS saved_tokens
  FROM (SELECT unnest(range(d + 1)) AS u, p, n_children, w FROM whole) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM whole a JOIN sums s ON a.d = s.d AND a.p = s.p LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]
"""


@query("op11_prefix_trie", ORACLE)
def op11_prefix_trie(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(with_shared_heads(conversation_turns(conversations)))
