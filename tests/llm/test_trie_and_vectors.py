"""Conversation tries, vector codes and near-duplicate vectors against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import prefixes, vecdup, veccodes

# ---------------------------------------------------------------- op11

TALK = "conv_id long, turn long, role string, text string, size long, n long, digest string, level int, key string"


def talks(seed=3):
    """Conversations with shared beginnings, nulls, ties, repeated rows, rows without an id, and one of 70 turns."""
    pick = random.Random(seed)
    texts = ["a", "bé", "ccc", "", None, "a,b", "1:x"]
    rows = []
    for c in [*range(0, 130), 205, 300, 301, -7, -100]:
        for turn in range(pick.randint(1, 12)):
            rows.append((c, pick.choice([turn, turn, None]), pick.choice(["user", "bot", None]), pick.choice(texts[: 2 + turn % 6])))
    rows += [(c, t, "user", "same") for c in (400, 401, 500) for t in range(70)]
    rows += [(501, t, "user", "same" if t < 40 else str(t)) for t in range(60)]
    rows += [rows[5], rows[5], (None, 1, "user", "no conversation"), (600, 1, None, "x"), (600, 1, None, "x"), (600, 1, "x", None)]
    pick.shuffle(rows)
    return rows


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [3, 8])
def test_trie_holds_every_prefix(spark, monkeypatch, width):
    monkeypatch.setattr(prefixes, "GROUP_BITS", 1)
    monkeypatch.setattr(prefixes, "ID_BITS", 3)
    table = spark.createDataFrame([(*r, 9, 9, "own", 9, "own") for r in talks()], TALK).repartition(7)
    turns = prefixes.with_shared_heads(prefixes.conversation_turns(table))
    found = prefixes.prefix_trie(turns, width)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, trie(talks())))
    assert {t for _, t in found.dtypes if t != "string"} == {"bigint"}


def test_trie_of_nothing_has_no_node(spark):
    turns = prefixes.conversation_turns(spark.createDataFrame([], TALK))
    assert prefixes.prefix_trie(prefixes.with_shared_heads(turns)).collect() == []


def test_turns_of_one_conversation_are_numbered_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("r").alias("role"), F.col("id").cast("string").alias("text"))
        found = prefixes.conversation_turns(table.repartition(5))
        assert found.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n")).first() == (5000, 5000, 1, 5000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---------------------------------------------------------------- op12

CODED = "vec_id long, embedding array<float>, label int, error string, code int, vec string, size int"


def codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((gap(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(v, p)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(vs) for c in zip(*vs)] if vs else e for vs, e in zip(own, books[p])]
    out, total = [], {}
    for i, v, g in kept:
        best = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in best)
        total[g] = total.get(g, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, g))
    return [(i, c, e, total[g]) for i, c, e, g in out], books


def vectors(seed=5, n=90, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, size))
    rows = [(i, (centres[i % 6] + rng.standard_normal(size) * (0.02 if i % 3 else 0.4)).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    rows += [rows[4], (4, rows[9][1], 1), (None, rows[11][1], None), (700, None, 1), (701, [0.0] * size, 2)]
    rows += [(702, [float("nan")] * size, 1), (703, [None, *rows[0][1][1:]], 1), (704, [float("inf"), *rows[0][1][1:]], None)]
    rng.shuffle(order := list(range(len(rows))))
    return [rows[i] for i in order]


def own_columns(rows):
    return [(*r, "own", 3, "own", 4) for r in rows]


def test_codes_are_those_of_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(veccodes, "BLOCK", 7)
    table = spark.createDataFrame(own_columns(vectors()), CODED).repartition(3)
    found, books = veccodes.vector_codes(table)
    want, plain = codes(vectors())
    assert books == plain
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert found.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint")]


def test_codes_of_few_or_no_vectors(spark):
    few = [(3, [0.25] * 16, None), (1, [-0.5] * 16, 2), (2, None, 2)]
    found, books = veccodes.vector_codes(spark.createDataFrame(own_columns(few), CODED))
    assert books == codes(few)[1] and {r.error for r in found.collect()} <= {0}
    found, books = veccodes.vector_codes(spark.createDataFrame([], CODED))
    assert found.collect() == [] and books == []
    with pytest.raises(ValueError, match="one length"):
        veccodes.vector_codes(spark.createDataFrame(own_columns([(1, [0.5] * 16, 1), (2, [0.5] * 8, 1)]), CODED))


# ---------------------------------------------------------------- op13


def linked(rows, least=0.9):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, fine)]
    unit = [v if v is None else v / np.linalg.norm(v) for v in unit]
    near = [[j for j in range(len(rows)) if j != i and fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(len(rows))]
    seen, out = {}, [None] * len(rows)
    for i in range(len(rows)):
        if i not in seen:
            stack, group = [i], {i}
            while stack:
                for j in near[stack.pop()]:
                    if j not in group:
                        group.add(j)
                        stack.append(j)
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            for j in group:
                seen[j] = True
                out[j] = (rows[j][0], len(near[j]), min(ids, default=None), rows[j][0] == min(ids, default=None))
    return out


def groups(seed=8, size=24):
    """Tight groups, loose chains, copies, pairs on both sides of the bound, and vectors that link with nothing."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, (n, noise) in enumerate([(150, 0.02), (90, 0.07), (40, 0.1), (25, 0.15), (200, 1.0)]):
        centre = rng.standard_normal(size) if noise < 1 else np.zeros(size)
        rows += [(1000 * g + i, (centre + noise * rng.standard_normal(size)).tolist()) for i in range(n)]
    rows += [rows[3], (5001, rows[3][1]), (5002, (2.5 * np.array(rows[3][1])).tolist()), (None, rows[3][1]), (None, rng.standard_normal(size).tolist())]
    rows += [(6000, None), (6001, []), (6002, [0.0] * size), (6003, [float("nan")] * size), (6004, [None] * size), (6005, [1.0, 2.0]), (6006, [2.0, 4.0])]
    rows += [(6007, [float("inf")] * size), (6008, [1e300] * size), (6009, [1e-300] * size)]
    return rows


EMBEDDED = "vec_id long, embedding array<double>, label int, k long, n_links string, weight int, t int"


@pytest.mark.parametrize("most", [4096, 30])
def test_links_are_those_of_all_pairs(spark, most):
    rows = groups()
    table = spark.createDataFrame([(*r, 1, 5, "own", 6, 7) for r in rows], EMBEDDED).repartition(3)
    found = vecdup.near_vectors(table, recall=0.9999, most=most)
    want = linked(rows)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_recall_at_few_vectors_a_bucket(spark):
    """Many small buckets: links are found with the probability asked for, and none that is not there."""
    rows = groups()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for vec_id, n_links, *_ in vecdup.near_vectors(table, occupancy=8).collect():
        found.setdefault(vec_id, []).append(n_links)
    want = {}
    for vec_id, n_links, *_ in linked(rows):
        want.setdefault(vec_id, []).append(n_links)
    assert all(a <= b for k in want for a, b in zip(sorted(found[k]), sorted(want[k])))
    assert sum(map(sum, found.values())) >= 0.98 * sum(map(sum, want.values()))


def test_no_vectors(spark):
    assert vecdup.near_vectors(spark.createDataFrame([], EMBEDDED)).collect() == []
    assert vecdup.near_vectors(spark.createDataFrame([(3, None, 1, 1, "", 1, 1)], EMBEDDED)).collect() == [(3, 0, 3, True)]


def test_tables_follow_from_the_number_of_vectors():
    assert vecdup.layout(500, 0.9, 0.99, 1024) == (6, 4)
    tables, bits = vecdup.layout(10**9, 0.9, 0.99, 1024)
    assert bits == 20 and (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables <= 0.01
