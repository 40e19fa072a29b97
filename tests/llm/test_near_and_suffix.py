"""SimHash and suffix dedup against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import linked, without_repeats
from data import empty, table
from tidelog.llm import simhash, suffixes


def near_codes(n, seed=1):
    pick = np.random.default_rng(seed)
    codes = pick.integers(0, 1 << 63, size=max(1, n // 15), dtype=np.uint64)[pick.integers(0, max(1, n // 15), n)]
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << pick.integers(0, 64, n).astype(np.uint64))
    return np.unique(codes)


@pytest.mark.parametrize("n", [1, 2, 17, 300, 900])
def test_index_finds_every_link(n):
    codes = near_codes(n)
    got = simhash.join_bucket(codes, 4)
    want = linked([int(c) for c in codes], 4)
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_gray_rank_inverts_the_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_fingerprint_by_hand():
    import xxhash

    text = "The quick Brown\tfox  jumps over THE É dog"
    words = "the quick brown fox jumps over the É dog".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fold(simhash.shingle_hashes(text, 4)) == want
    assert simhash.fold(simhash.shingle_hashes(None, 4)) == simhash.fold(simhash.shingle_hashes(" \n", 4)) == 0
    assert simhash.fold(simhash.shingle_hashes("a B", 4)) == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("most", [simhash.MOST, 4])
def test_components_on_dense_fingerprints(spark, most):
    codes = near_codes(400, seed=4)
    signed = codes.view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), 4, most)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = linked([int(c) for c in codes], 4)
    got = [roots.get(c, c) for c in signed]
    assert len(set(zip(got, want))) == len(set(want)) == len(set(got))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(70)] + [(200, 300), (300, 250)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 71)}, 250: 200, 300: 200}


def test_near_duplicates(spark):
    docs = table(spark)
    found = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    codes = {(r.doc_id, r.text): simhash.fold(simhash.shingle_hashes(r.text, 4)) for r in rows}
    keys = list(codes)
    label = linked([codes[k] for k in keys], 4)
    ids = {}
    for k, l in zip(keys, label):
        if k[0] is not None:
            ids[l] = min(ids.get(l, k[0]), k[0])
    want = [(k[0], f"{codes[k]:016x}", ids.get(l)) for k, l in zip(keys, label)]
    want.append(next(w for w in want if w[0] == 7))  # the row that is there twice
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {w[2] for w in want} - {None}
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_anchors_cover_every_window_once():
    pick = random.Random(1)
    for text in (b"a" * 700, bytes(pick.choices(b"abcd ", k=1500)), b"ab" * 300, b"x" * 199, b"y" * 200):
        first, count, at, _ = suffixes.anchors(np.frombuffer(text, np.uint8))
        assert sum(count) == max(0, len(text) - 199)
        assert all(0 <= a - n + 1 and a <= 200 - 64 for a, n in zip(at, count))


def test_deep_shallow_order():
    pick = random.Random(2)
    stems = [bytes(pick.choices(b"ab", k=40)) for _ in range(6)]
    texts = [stems[pick.randrange(6)][: pick.randint(0, 40)].ljust(40, b"a") for _ in range(300)] + [bytes(pick.choices(b"\x00\x01\xfe\xff", k=40)) for _ in range(100)]
    flat = np.frombuffer(b"".join(texts) + bytes(8), np.uint8).astype(np.uint64)
    words = sum(flat[i : len(flat) - 8 + i] << np.uint64(8 * (7 - i)) for i in range(8))
    group = np.array([pick.randrange(3) for _ in texts])
    order, leaf = suffixes.deep_shallow(words, np.arange(len(texts)) * 40, group, 5)
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))
    for k in range(1, len(order)):
        same = (group[order[k]], texts[order[k]]) == (group[order[k - 1]], texts[order[k - 1]])
        assert same == (leaf[k] == leaf[k - 1])


@pytest.mark.parametrize("most", [suffixes.MOST, 1, 0])
def test_repeats_are_removed(spark, most):
    pick = random.Random(3)
    noise = lambda n: "".join(pick.choice("abcdefgh \né") for _ in range(n))
    passages = [noise(pick.choice([150, 190, 200, 201, 260, 400, 900])) for _ in range(10)]
    rows = [(i, "".join(pick.choice([noise(pick.randint(0, 300)), pick.choice(passages), pick.choice(passages)[pick.randint(0, 60) :]]) for _ in range(pick.randint(0, 6)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "a" * 3000), (903, "ab" * 900), (904, "xyz" * 70), (905, "a" * 199), (None, rows[3][1]), (None, noise(500)), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kept string")
    found = suffixes.remove_repeats(docs, most=most)
    assert sorted([tuple(r)[:5] for r in found.collect()], key=str) == without_repeats(rows)
    assert found.where(F.sha2("kept", 256) != F.col("kept_sha256")).count() == 0


def test_nothing_to_remove(spark):
    assert suffixes.remove_repeats(empty(spark)).collect() == []
    assert suffixes.remove_repeats(table(spark).where("doc_id = 102")).first()[1:4] == (0, 0, 0)
