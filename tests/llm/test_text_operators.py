"""Rules, classifier, personal data, pieces and lines against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import personal, text_counts, without_repeated_lines
from data import empty, rows, table
from tidelog.llm import classifier, lines, pieces, privacy, rules, trees
from tidelog.llm.textstats import COUNTS, FEATURES, describe, repeats


def test_text_counts():
    for r in rows():
        n, chars, symbols, dup, repeat, _ = text_counts(r[1])
        got = dict(zip(COUNTS, describe(r[1])[0]))
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert len(describe(r[1])[1]) == len(FEATURES)


def test_repeats_with_many_distinct_words():
    ids = np.array([5, 6, 7, 5, 6, 7, 8, 9] * 2)
    assert (repeats(ids, 10) == repeats(ids, 1 << 22)).all()


def test_quality_rules(spark):
    docs = table(spark)
    found = rules.quality_rules(docs).collect()
    assert len(found) == docs.count()
    want = Counter(text_counts(r.text) for r in docs.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
    assert not any(r.kept and r.base_failed for r in found)
    assert rules.quality_rules(empty(spark)).collect() == []


def test_thresholds_follow_the_group(spark):
    pick = random.Random(2)
    word = lambda n: "".join(pick.choice("abcdefghij") for _ in range(n))
    text = lambda n: " ".join(word(n) for _ in range(80))
    docs = [(i, text(5), "en", "short") for i in range(150)] + [(200 + i, text(12), "en", "long") for i in range(150)]
    docs += [(998, text(12), "en", "short"), (999, text(5), "en", "long"), (1000, text(5), "en", "new")]
    found = {r.doc_id: r.kept for r in rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not found.pop(998) and not found.pop(999)
    assert all(found.values())


def test_share_cutoffs_follow_the_upper_tail(spark):
    shares = [r.name for r in rules.RULES if not r.both]
    value = lambda group, i: 0.0 if group == "even" or i % 5 < 3 else 0.05 + i / 2000
    table = [("en", g, *[value(g, i)] * len(shares), 5.0) for g in ("even", "tail") for i in range(200)]
    stats = spark.createDataFrame(table, ", ".join(["__lang string", "__source string", *[f"{n} double" for n in shares], "mean_word double"]))
    found = {r["__source"]: r for r in rules.fences(stats, rules.RULES, 100).collect()}
    for r in rules.RULES:
        if not r.both:
            assert found["even"][f"{r.name}_high"] == r.least
            assert found["tail"][f"{r.name}_high"] > 2 * r.least


def test_sketch_quantiles(spark):
    values = [(float(v),) for v in np.random.default_rng(3).lognormal(0, 2, 4000)] + [(0.0,)] * 50
    sketch = rules.sketches(spark.createDataFrame(values, "v double").repartition(5), [], ["v"])
    halves = rules.merged(sketch.unionAll(sketch), [])
    for s in (sketch, halves):
        got = rules.quantiles(s, [], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
        for name, rank in (("a", 0.25), ("b", 0.5), ("c", 0.9)):
            true = np.quantile([v for v, in values], rank, method="inverted_cdf")
            assert abs(got[name] - true) <= 1.1 * rules.ACCURACY * true


def test_forest_learns_and_flattens():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = trees.fit(x[:2000], y[:2000], rounds=40)
    assert ((forest.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    one = forest.score(x[2000:2003])

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(one, [walk(r) for r in x[2000:2003]])
    assert trees.fit(np.zeros((0, 5)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert trees.fit(x[:5], np.ones(5)).score(x[:2])[0] > 0.8


def test_classifier(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(60)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    forest = classifier.fit_quality(docs, labels)
    scored = classifier.score_quality(docs, forest)
    assert sorted(scored.columns) == sorted(docs.columns)
    assert scored.count() == docs.count() and scored.where("score between 0 and 1").count() == docs.count()
    assert classifier.keep_quality(docs, forest).columns == docs.columns
    assert classifier.score_quality(empty(spark), forest).collect() == []
    none = classifier.fit_quality(docs, labels.limit(0))
    assert {r.score for r in classifier.score_quality(docs, none).collect()} == {0.5}


def test_held_out_rows_teach_nothing(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (classifier.fit_quality(docs, x) for x in (labels, flipped))
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = classifier.op6_quality_trees(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.95


SILENT = privacy.Judge(trees.Forest(3, 0.0, np.zeros((0, 7), int), np.zeros((0, 7)), np.zeros((0, 8))), (9.0,) * 4)


def test_base_spans(spark):
    pick = random.Random(5)
    parts = ["1", "2", "45", "4111111111111111", " ", "-", ".", "+", "@", "a", "b.c", "(", ")", "é", "𝔘", "\n", "192.168.1.1", "256.1.1.1", "x@y.zz", "_", "+49 170 1234567", "%", "00255"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(600)]
    texts += [None, "", "1" * 20_000, "a" * 60_000, "1." * 3000, "a@b" + ".c" * 3000, "+1" + " (" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in privacy.find_personal_data(docs, SILENT).collect():
        assert [(s.start, s.rank, s.end) for s in r.base] == personal(r.text)
        assert r.spans == r.base


def test_added_spans_are_judged(spark):
    forest = trees.fit(np.random.default_rng(0).normal(size=(200, privacy.FEATURES)), np.arange(200) % 2.0, rounds=6, depth=3)
    x = np.random.default_rng(1).normal(size=(30, privacy.FEATURES))
    scored = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").select(privacy.score(forest, F.col("x")).alias("s"))
    assert np.allclose(sorted(r.s for r in scored.collect()), sorted(forest.score(x)))
    eager = privacy.Judge(SILENT.forest, (0.1,) * 4)
    docs = spark.createDataFrame([(1, "call 030 1234 5678 or me (at) example (dot) com, x@y.zz", True)], "doc_id long, text string, spans boolean")
    row = privacy.find_personal_data(docs, eager).first()
    assert [(s.start, s.rank, s.end) for s in row.base] == [(49, 0, 55)]
    assert [row.text[s.start : s.end] for s in row.spans] == ["030 1234 5678", "me (at) example (dot) com", "x@y.zz"]
    assert privacy.redact(docs, eager).first().text == "call [phone] or [email], [email]"


def test_personal_data_edges(spark):
    docs = table(spark, n=20)
    judge = privacy.fit_judge(docs)
    assert judge.cuts == (float("inf"),) * 4  # nothing proposed, nothing added
    assert {r.proposed for r in privacy.find_personal_data(docs, judge).collect()} == {"mine"}
    assert privacy.find_personal_data(docs, judge).count() == docs.count()
    assert privacy.find_personal_data(empty(spark), judge).collect() == []


def test_judge_learns_from_all_documents(spark):
    n = 20_400
    last = [r[0] for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(400).collect()]
    texts = ["call +49 170 1234567 now", "x@y.zz", "order 12345678 of 1234567", "at 1.2.3.4 or 300.2.3.4"]
    own = {i: " ".join(texts[: k % 5]) for k, i in enumerate(last)}
    docs = spark.createDataFrame([(i, own.get(i, "")) for i in range(n)], "doc_id long, text string")
    judge = privacy.fit_judge(docs)
    assert len(judge.forest.leaf) == 30 and judge.cuts[0] < 1 and judge.cuts[3] == float("inf")


def test_sums_of_many_proposals_are_taken_in_tasks(spark, monkeypatch):
    pick = np.random.default_rng(2)
    made = [(pick.integers(0, privacy.BINS, privacy.FEATURES).tolist(), bool(k % 3), int(pick.integers(1, 9)), k % 4) for k in range(300)]
    found = spark.createDataFrame(made, "x array<int>, confirmed boolean, n long, rank int").repartition(3)
    x, y, n = (np.array([r[c] for r in made], np.int64) for c in range(3))
    empty_tree = (np.zeros(3, np.int64), np.full(3, np.inf))
    local = lambda *tree: trees.level_sums(x, y, n, *tree, privacy.BINS)
    forest = trees.grow(local, int((n * (1 - y)).sum()), int((n * y).sum()), privacy.FEATURES, privacy.BINS, rounds=3, depth=2)
    again = trees.fit(np.repeat(x, n, 0), np.repeat(y, n), rounds=3, depth=2)
    assert np.allclose(forest.score(x), again.score(x), atol=1e-4)
    monkeypatch.setattr(privacy, "LOCAL", 0)
    spread = privacy._summing(found)(lambda x, y, n, rank: trees.level_sums(x, y, n, forest, *empty_tree, 1, privacy.BINS))
    assert (spread == local(forest, *empty_tree, 1)).all()


@pytest.fixture(scope="module")
def raw():
    return pieces._model_bytes(pieces.MODEL)


def test_protobuf_parity(raw):
    message = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    message.ParseFromString(raw)
    model = pieces.parse(raw)
    assert model.pieces == [(p.piece, p.score, p.type) for p in message.pieces]
    assert (model.kind, model.byte_fallback, model.unknown) == (message.trainer_spec.model_type, message.trainer_spec.byte_fallback, message.trainer_spec.unk_id)
    spec = message.normalizer_spec
    assert (model.dummy_prefix, model.squeeze, model.escape, model.charsmap) == (spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.precompiled_charsmap)


def test_both_libraries_agree(raw):
    texts = [r[1] or "" for r in rows()] + ["  two  spaces \n\t\x00", "é𝔘日本 🙂‍👩", "a" * 5000, " ", "<s> </s> <0x0A>", "x" + " " * 37 + "y", "▁ mark"]
    ids, parity = pieces.encode_batch(raw, texts, 1)
    assert all(parity)
    assert pieces.loaded(raw)[0].decode_batch(ids, skip_special_tokens=False)[:-1] == texts[:-1]


def test_bare_tokenizer_gives_what_the_whole_one_gives(raw):
    texts = [r[1] or "" for r in rows()] + ["", " ", "  two  spaces \n\t\x00", "é𝔘日本 🙂‍👩", "▁ mark▁", "▁", "x" + " " * 37 + "y ", "<s> <0x0A>"]
    whole = pieces.loaded(raw)[0]
    ids = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    assert pieces.bare(raw) is not None and whole.pre_tokenizer is None
    assert pieces.encode_batch(raw, texts, pieces.THREADS)[0] == ids
    assert pieces.decode_batch(raw, ids) == whole.decode_batch(ids, skip_special_tokens=False)


def test_unigram_models_take_scores():
    parts = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("▁a", -1.0, 1), ("b", -2.0, 1), ("a", -2.5, 1), ("ab", -2.2, 1)]
    tokenizer = pieces.build(pieces.Model(pieces=parts, kind=pieces.UNIGRAM))
    assert tokenizer.encode("ab ab", add_special_tokens=False).tokens == ["▁a", "b", "▁a", "b"]


def test_encode_and_decode(spark):
    docs = table(spark, n=15)
    tokens = pieces.encode(docs.withColumn("ids", F.lit("clash")))
    assert tokens.where("not parity").count() == 0 and tokens.count() == docs.count()
    back = pieces.decode(tokens.drop("text"))
    pairs = lambda df: Counter((r.doc_id, r.text or "") for r in df.collect())
    assert pairs(back) == pairs(docs)
    assert pieces.encode(docs, carry=["doc_id"], digest=True).where("not round_trip").count() == 0
    assert pieces.encode(empty(spark)).collect() == []


def test_lines(spark):
    docs = table(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    found = lines.dedup_lines(docs.withColumn("n_lines", F.lit(-1)))
    got = {r.doc_id: r.text or "" for r in found.collect()}
    assert got == without_repeated_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert found.agg(F.sum("n_removed")).first()[0] > 400
    assert {(r.runs, r.id) for r in found.collect()} == {(4, "own")}
    assert lines.dedup_lines(empty(spark)).collect() == []


def test_repeated_rows_keep_their_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "z\na\nb\nc"), (2, "a\nb\nc\nd"), (3, None), (4, "\n\n\n\n")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.text, r.n_removed) for r in lines.dedup_lines(docs).collect())))
    want = [(1, "", 3), (1, "", 3), (None, "z\na\nb\nc", 0), (2, "d", 3), (3, None, 0), (4, "\n\n\n\n", 0)]
    assert got == sorted(map(str, want))
