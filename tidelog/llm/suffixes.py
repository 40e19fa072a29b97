"""Repeated byte strings: every 200-byte string that starts twice anywhere is removed, by sorting
suffixes deep-shallow.

Sorting every suffix of a corpus would move each text two hundred times. Instead:

1. Each window of 200 bytes names one anchor inside itself, the leftmost 64-byte gram with the
   smallest hash. Equal windows name equal grams at equal offsets, so only windows whose gram
   occurs twice in the corpus can repeat. Grams are counted as narrow rows.
2. Consecutive windows with one anchor form a context of at most 336 bytes. Contexts of
   repeated grams are cut from the texts, equal ones combined before the shuffle, and dealt by gram.
3. The windows of a gram's contexts are sorted as suffixes cut to 200 bytes: multikey quicksort
   with 8-byte characters to a depth of 16 bytes, then blind tries for what is still tied. A
   blind trie hangs all suffixes of a group off the path of one of them, by the first bit in
   which they differ; only that place is compared, and what hangs together is split again.
   Equal suffixes end in one leaf, and a leaf that stands for two starts is a repeat.
4. Covered bytes go back to their documents as intervals, and are merged and cut out.

A gram with more than ``MOST`` anchors does not meet in one task: its distinct contexts, counted
map-side, are spread window by window, and repeats are found by a distributed count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import documents, query
from tidelog.session import cut_lineage

WIDTH, GRAM = 200, 64
#: Characters of 8 bytes that the multikey quicksort looks at.
SHALLOW = 2
#: Anchors of a gram that one task sorts.
MOST = 20_000
#: Bytes of contexts sorted, or combined, at a time.
BLOCK = 2 << 20
KEY = ("k1", "k2")


# ---------------------------------------------------------------- anchors


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each ``gram`` bytes (a power of two): halves are combined, then mixed."""
    hashes, factor, size = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while size < gram:
        hashes = hashes[:-size] * np.uint64(factor) + hashes[size:]
        factor, size = factor * factor % (1 << 64), 2 * size
    for shift, times in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(times)
    return hashes ^ (hashes >> np.uint64(32))


def anchors(text: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's place in the first window, gram's hash) of
    each run of windows that share an anchor."""
    if len(text) < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = gram_hashes(text, gram)
    span = width - gram + 1
    value, place, size = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while size < span:
        step = min(size, span - size)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, place = np.where(first, left, right), np.where(first, place[:-step], place[step:])
        size += step
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return starts, np.diff(np.append(starts, len(place))), place[starts] - starts, value[starts].view(np.int64)


def _raw(scalar: pa.Scalar) -> bytes:
    return (scalar.as_py() or "").encode("utf-8", "surrogatepass")


def find_anchors(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "first", "count", "at", "gram"]
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            held, size = [], 0
            for row in range(batch.num_rows):
                found = anchors(np.frombuffer(_raw(batch.column("text")[row]), np.uint8), width, gram)
                held.append([np.full(len(found[0]), k[row]) for k in keys] + list(found))
                size += len(found[0])
                if size > 1 << 16 or row == batch.num_rows - 1:
                    columns = [np.concatenate(c) for c in zip(*held)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.astype(t)) for c, t in zip(columns, ("i8", "i8", "i4", "i2", "i2", "i8"))], names)
                    held, size = [], 0

    return keyed.select(*KEY, "text").mapInArrow(run, "k1 long, k2 long, first int, count short, at short, gram long")


# ---------------------------------------------------------------- contexts


def cut_contexts(listed: DataFrame, width: int) -> DataFrame:
    """(gram, at, context, members) from rows with text and ``anchors``; equal contexts of one
    task share a row."""
    schema = "gram long, at short, context binary, members array<struct<k1:long,k2:long,first:int>>"
    member = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int16()),
                 pa.array([k[2] for k in keys], pa.binary()), pa.array(list(held.values()), pa.list_(member))],
                ["gram", "at", "context", "members"])

        for batch in batches:
            for row in range(batch.num_rows):
                text = _raw(batch.column("text")[row])
                k1, k2 = batch.column("k1")[row].as_py(), batch.column("k2")[row].as_py()
                marks = batch.column("anchors")[row].values
                for first, count, at, gram in zip(*(marks.field(i).to_pylist() for i in range(4))):
                    key = (gram, at, text[first : first + count + width - 1])
                    if key not in held:
                        held[key] = []
                        size += len(key[2]) + 64
                    held[key].append((k1, k2, first))
                    size += 24
                if size > 8 * BLOCK:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    # The id is not needed here, but with it the shuffled texts are those that the end of the
    # job joins again, and Spark shuffles them once.
    return listed.select("doc_id", *KEY, "text", "anchors").mapInArrow(run, schema)


# ---------------------------------------------------------------- deep-shallow sorting


def _segments(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers that grow where a key changes along ``order``."""
    change = np.zeros(len(order), bool)
    for key in keys:
        change[1:] |= key[order[1:]] != key[order[:-1]]
    return np.cumsum(change)


def deep_shallow(words: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, leaf): suffixes sorted inside their groups, and the leaf of each place in that
    order, equal for equal suffixes. ``words[i]`` holds bytes i to i + 7 as one big-endian number,
    ``depth`` words are compared."""
    order = np.argsort(group, kind="stable")
    segment = _segments(order, group)
    # Multikey quicksort: one character at a time, inside what is still tied.
    for level in range(min(SHALLOW, depth)):
        word = words[start[order] + 8 * level]
        turn = np.lexsort((word, segment))
        order, word, segment = order[turn], word[turn], segment[turn]
        change = np.append(False, (segment[1:] != segment[:-1]) | (word[1:] != word[:-1]))
        segment = np.cumsum(change)
    leaf = np.full(len(order), -1, np.int64)
    live = np.arange(len(order))
    made = 0
    end = 64 * depth
    while len(live):
        # Blind tries: the first suffix of each tied group is the path the others hang off.
        seg = segment[live]
        head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        size = np.diff(np.append(head, len(seg)))
        path = start[order[live[np.repeat(head, size)]]]
        own = start[order[live]]
        bit = np.full(len(live), end, np.int64)
        above = np.zeros(len(live), bool)
        open_ = np.flatnonzero(np.repeat(size, size) > 1)
        for level in range(SHALLOW, depth):
            a, b = words[own[open_] + 8 * level], words[path[open_] + 8 * level]
            split = np.flatnonzero(a != b)
            if len(split):
                differ = a[split] ^ b[split]
                high = differ >> np.uint64(11)
                top = np.where(
                    high > 0, 53 - np.frexp(high.astype(np.float64))[1], 64 - np.frexp((differ & np.uint64(2047)).astype(np.float64))[1]
                )
                at = open_[split]
                bit[at] = 64 * level + top
                above[at] = a[split] > b[split]
                open_ = np.delete(open_, split)
            if not len(open_):
                break
        # Below the path, shortest shared prefix first; the path's own leaf; above it, longest first.
        rank = np.where(bit == end, end, np.where(above, 2 * end - bit, bit))
        turn = np.lexsort((rank, seg))
        order[live] = order[live][turn]
        seg, rank, bit = seg[turn], rank[turn], bit[turn]
        fresh = np.cumsum(np.append(True, (seg[1:] != seg[:-1]) | (rank[1:] != rank[:-1])))
        settled = bit == end
        leaf[live[settled]] = made + fresh[settled]
        segment[live] = made + fresh
        made += int(fresh[-1]) + 1
        live = live[~settled]
    return order, leaf


def repeated_windows(contexts: list[bytes], group: np.ndarray, at: np.ndarray, weight: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its windows start twice or more. ``group`` numbers the grams,
    ``at`` is the anchor's place in the first window, ``weight`` how often the context occurs."""
    count = np.fromiter((len(c) - width + 1 for c in contexts), np.int64, len(contexts))
    # A gram with one context only: nothing to sort, its windows occur as often as it does.
    alone = np.bincount(group)[group] == 1
    out = [np.full(n, w > 1) for n, w in zip(count, weight)]
    if alone.all():
        return out
    mixed = np.flatnonzero(~alone)
    contexts, group, at, weight, count = [contexts[i] for i in mixed], group[mixed], at[mixed], weight[mixed], count[mixed]
    flat = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8).astype(np.uint64)
    words = np.zeros(len(flat) - 8, np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | flat[i : len(words) + i]
    owner = np.repeat(np.arange(len(contexts)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum([0, *map(len, contexts)])[:-1]
    # The anchor's place in a window is part of what makes windows comparable.
    bucket = group[owner] * np.int64(width + 1) + (at[owner] - inside)
    order, leaf = deep_shallow(words, base[owner] + inside, bucket, width // 8)
    _, slot = np.unique(leaf, return_inverse=True)
    twice = np.bincount(slot, weight[owner[order]]) > 1
    found = np.zeros(len(owner), bool)
    found[order] = twice[slot]
    for i, windows in zip(mixed, np.split(found, np.cumsum(count)[:-1])):
        out[i] = windows
    return out


def covered(windows: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Byte intervals under the marked windows."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], windows, [False])).astype(np.int8)))
    return [(int(a), int(b) - 1 + width) for a, b in zip(edges[::2], edges[1::2])]


def sort_contexts(dealt: DataFrame, width: int) -> DataFrame:
    """(k1, k2, from, to) of covered bytes, from contexts sorted by gram within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            if held and sum(b.nbytes for b in held) > BLOCK:
                last = held[-1].column("gram")[-1].as_py()
                cut = int(np.searchsorted(grams != last, True)) if grams[-1] != last else len(grams)
                if cut < len(grams):
                    yield from _sorted_block([*held, batch.slice(0, cut)], width)
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield from _sorted_block(held, width)

    return dealt.mapInArrow(run, "k1 long, k2 long, `from` int, `to` int")


def _sorted_block(batches: list[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    grams = table["gram"].to_numpy()
    bounds = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    first = 0
    # Whole grams, about BLOCK bytes at a time.
    sizes = np.cumsum([len(c) for c in table["context"].to_pylist()])
    while first < len(grams):
        goal = (sizes[first - 1] if first else 0) + BLOCK
        later = bounds[(bounds > first) & (sizes[np.maximum(bounds - 1, 0)] >= goal)]
        end = int(later[0]) if len(later) else len(grams)
        yield from _sorted_part(table.slice(first, end - first), width)
        first = end


def _sorted_part(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, list] = {}
    for gram, at, context, members in zip(*(table[c].to_pylist() for c in ("gram", "at", "context", "members"))):
        seen.setdefault((gram, at, context), []).extend(members)
    keys, members = list(seen), list(seen.values())
    numbers: dict[int, int] = {}
    group = np.array([numbers.setdefault(k[0], len(numbers)) for k in keys], np.int64)
    weight = np.array([len(m) for m in members], np.int64)
    found = repeated_windows([k[2] for k in keys], group, np.array([k[1] for k in keys], np.int64), weight, width)
    rows = [
        (m["k1"], m["k2"], m["first"] + a, m["first"] + b)
        for who, windows in zip(members, found) if windows.any() for a, b in covered(windows, width) for m in who
    ]
    for i in range(0, len(rows), 1 << 16):
        columns = list(zip(*rows[i : i + (1 << 16)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "from", "to"])


def runs_of(nths: Column, width: int) -> Column:
    """Sorted window numbers as byte intervals, one per run of neighbours."""
    begins = F.filter(nths, lambda n: ~F.array_contains(nths, n - 1))
    ends = F.filter(nths, lambda n: ~F.array_contains(nths, n + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("from"), (b + width).alias("to")))


def count_windows(contexts: DataFrame, width: int) -> DataFrame:
    """The same for grams too common for one task: distinct contexts are spread window by window
    and the windows counted."""
    each = contexts.withColumn("context_hash", F.unhex(F.md5("context")))
    distinct = each.groupBy("gram", "at", "context_hash").agg(F.sum(F.size("members")).alias("weight"), F.max("context").alias("context"))
    spread = distinct.select(
        "gram", "at", "context_hash", "weight",
        F.posexplode(F.transform(
            F.sequence(F.lit(1), F.octet_length("context") - (width - 1)), lambda i: F.unhex(F.md5(F.substring("context", i, F.lit(width))))
        )).alias("nth", "window"),
    )
    twice = spread.groupBy("gram", "window").agg(F.sum("weight").alias("n")).where("n > 1").select("gram", "window")
    hits = spread.join(twice, ["gram", "window"], "left_semi").groupBy("gram", "at", "context_hash").agg(F.collect_set("nth").alias("nths"))
    return (
        each.select("gram", "at", "context_hash", "members").join(hits, ["gram", "at", "context_hash"])
        .withColumn("runs", runs_of(F.array_sort("nths"), width))
        .select(F.explode("members").alias("m"), "runs").select("m.*", F.inline("runs"))
        .select("k1", "k2", (F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to")).alias("to"))
    )


# ---------------------------------------------------------------- documents


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, maximal runs of the bytes that the intervals cover; touching ones join."""
    turn = np.argsort(starts, kind="stable")
    starts, far = starts[turn], np.maximum.accumulate(ends[turn])
    begins = np.flatnonzero(np.append(True, starts[1:] > far[:-1]))
    return starts[begins], far[np.append(begins[1:], len(starts)) - 1]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, gram: int = GRAM, most: int = MOST, content: bool = True
) -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, with ``content``, ``kept``: the remaining bytes (they need not be valid UTF-8,
    as a repeat can end inside a character).

    ``width`` is a multiple of 8, ``gram`` a power of two below it. A null text is empty; texts
    shorter than ``width`` stay whole. Rows that repeat id and text are two places where their
    strings start, so both go. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Id and text name a row, so that null and repeated ids do no harm.
    keyed = docs.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).alias("doc_id"), text.alias("text")
    )
    # Found twice rather than stored: the rows outweigh the work.
    places = find_anchors(keyed, width, gram)
    repeated = cut_lineage(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    found = places.join(repeated, "gram")

    def contexts(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy(*KEY).agg(F.collect_set(F.struct("first", "count", "at", "gram")).alias("anchors"))
        return cut_contexts(keyed.join(lists, list(KEY)), width)

    usual = contexts(found.where(F.col("n") <= most)).repartition("gram").sortWithinPartitions("gram", "at", "context")
    spans = sort_contexts(usual, width)
    if not repeated.where(F.col("n") > most).isEmpty():
        spans = spans.unionByName(count_windows(contexts(found.where(F.col("n") > most)), width))
    spans = spans.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    joined = keyed.join(spans, list(KEY), "left").select("doc_id", "text", "spans")
    kind = dict(joined.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if content else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out = []
                for row in range(part.num_rows):
                    raw, marks = _raw(part.column("text")[row]), part.column("spans")[row]
                    kept, gone, runs = raw, 0, 0
                    if marks.is_valid:
                        a, b = merge(marks.values.field(0).to_numpy(), marks.values.field(1).to_numpy())
                        kept = b"".join(raw[x:y] for x, y in zip(np.append(0, b), np.append(a, len(raw))))
                        gone, runs = int((b - a).sum()), len(a)
                    out.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
                columns = list(zip(*out))[: 5 if content else 4]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])

    return joined.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), content=False)
