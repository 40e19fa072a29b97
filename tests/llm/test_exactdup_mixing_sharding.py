"""Exact duplicates, mixing and sharding against plain versions."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from brute import WORD, water
from data import empty, table
from tidelog.llm import exactdup, mixing, sharding


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return groups


def test_exact_duplicates(spark):
    docs = table(spark)
    for keep, choose in (("smallest", min), ("largest", max)):
        found = exactdup.exact_duplicates(docs, keep=keep)
        assert found.columns == [c for c in docs.columns if c != "kept"] + ["keep_id", "group_size", "kept"]
        groups = expected_groups(docs.collect())
        for r in found.collect():
            ids = groups[r.text or ""]
            known = [i for i in ids if i is not None]
            keep_id = choose(known) if known else None
            assert (r.keep_id, r.group_size, r.kept) == (keep_id, len(ids), r.doc_id == keep_id)
        assert found.count() == docs.count()


def test_colliding_hashes_are_told_apart(spark):
    docs = table(spark)
    strict = exactdup.exact_duplicates(docs).orderBy("doc_id", "text").collect()
    weak = exactdup.exact_duplicates(docs, hash_of=lambda t: F.substring(F.md5(t), 1, 1)).orderBy("doc_id", "text").collect()
    assert strict == weak


def test_drop_exact_duplicates(spark):
    docs = table(spark)
    kept = exactdup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {(r.kept, r.id) for r in kept.collect()} == {(False, "own")}
    texts = Counter(r.text or "" for r in kept.collect())
    assert set(texts) == set(expected_groups(docs.collect()))
    assert {t for t, n in texts.items() if n > 1} == {docs.where("doc_id = 7").first().text}  # one row twice
    assert exactdup.drop_exact_duplicates(empty(spark)).collect() == []


def test_water_filling(spark):
    sizes = [100, 1000, 10, 0, 500, 7]
    weights = [3.0, 1.0, 2.0, 3.0, 1.0, 2.0]
    sources = spark.createDataFrame(list(zip(range(6), sizes, weights)), "__source int, source_size long, weight double")
    for share, epochs in ((1.5, 2.0), (0.3, 1.0), (1.99, 2.0), (0.5, 4.0)):
        got = [r.target for r in mixing.water_fill(sources, share, epochs).orderBy("__source").collect()]
        want = water(sizes, weights, share, epochs)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, want))
    over = mixing.water_fill(sources, 5.0, 2.0).agg(F.sum("target")).first()[0]
    assert over == 2 * sum(sizes)


def test_mix(spark):
    docs = table(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
        assert 0 <= r.copies <= 2
    names = sorted((s for s in by_source if s is not None)) + [None]
    sizes = [sum(r.size for r in by_source[s]) for s in names]
    want = water(sizes, [[3.0, 1.0, 2.0][i % 3] for i in range(len(names))], 1.5, 2.0)
    for s, size, target in zip(names, sizes, want):
        assert {r.source_size for r in by_source[s]} == {size}
        assert all(abs(r.target - target) < 1e-6 for r in by_source[s])
        taken = sum(r.copies * r.size for r in by_source[s])
        assert abs(taken - target) <= max(r.size for r in by_source[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(docs, seed=5).exceptAll(mixing.mix(docs)).count() > 0
    assert mixing.mix(empty(spark)).collect() == []


def test_mixed_documents(spark):
    docs = table(spark)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r.size, r.weight) for r in mixed.collect()} == {(9, 5)}
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    wanted = 1.5 * sum(len(WORD.findall(r.text or "")) for r in docs.collect())
    assert abs(words - wanted) < 0.2 * wanted


def test_shards(spark):
    docs = table(spark, n=1500)
    placed, versions = sharding.shard_documents(docs)
    rows = placed.collect()
    assert len(rows) == docs.count()
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(loads) == set(range(8))
    assert max(loads.values()) - min(loads.values()) <= max(r.size for r in rows)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sizes = Counter(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert Counter(r.size for r in rows) == sizes
    assert {r.virtual_slot for r in versions.collect()} == set(range(sharding.SLOTS))


def test_rebalancing_edits_the_map(spark):
    docs = table(spark, n=400)
    _, versions = sharding.shard_documents(docs, shards=4, slots=256)
    records = docs.select((F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"), sharding.slot_of("doc_id", "text", 256).alias("virtual_slot"))
    sizes = sharding.slot_bytes(records)
    again = sharding.rebalance(versions, sizes, 4)
    assert again.count() < 64  # near balance, few slots move
    grown = sharding.rebalance(versions, sizes, 5)
    assert {r.version for r in grown.collect()} == {versions.agg(F.max("version")).first()[0] + 1}
    after = sharding.current(versions.unionByName(grown))
    assert {r.shard for r in after.collect()} == set(range(5))
    loads = [r.b for r in after.join(sizes, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(loads) - min(loads) <= sizes.agg(F.max("bytes")).first()[0]
    before = {r.virtual_slot: r.shard for r in sharding.current(versions).collect()}
    assert {r.virtual_slot: r.shard for r in sharding.current(versions.unionByName(grown), version=versions.agg(F.max("version")).first()[0]).collect()} == before
    shrunk = sharding.current(versions.unionByName(sharding.rebalance(versions, sizes, 3)))
    assert {r.shard for r in shrunk.collect()} <= {0, 1, 2}


def test_empty_shards(spark):
    placed, versions = sharding.shard_documents(empty(spark), slots=16)
    assert placed.collect() == [] and versions.count() == 16


def test_digest_columns(spark):
    docs = table(spark)
    row = exactdup.exact_duplicates(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), carry=["doc_id", "sha"]).where("doc_id = 102").first()
    assert row.sha == hashlib.sha256(b"").hexdigest() and row.group_size == 2
