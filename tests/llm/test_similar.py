"""The near-dedup stage against all pairs."""

import random

import pytest

import corpus_pipeline
from brute import WORD
from data import COLUMNS, empty, rows
from tidelog.llm import similar


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(docs):
    """(id, smallest id reachable) of every row, from the Jaccard of all pairs."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            low[top(i)] = min(low.get(top(i), doc), doc)
    return [(doc, low.get(top(i))) for i, (doc, _) in enumerate(docs)]


def near(seed=4):
    """Texts with copies on both sides of 0.8, chains of copies, and a passage that all share."""
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(6))
    common = " ".join(word() for _ in range(40))
    out = []
    for i in range(40):
        words = [word() for _ in range(pick.randint(1, 200))]
        for _ in range(pick.randint(1, 6)):
            out.append((len(out), " ".join(words) + (" " + common if i % 3 == 0 else "")))
            for _ in range(pick.randint(0, 1 + len(words) // 40)):
                words[pick.randrange(len(words))] = word()
    return out


@pytest.mark.parametrize("most", [8192, 4])
def test_every_pair_over_the_bound_links(spark, most):
    docs = near()
    docs += [(None, " \n"), (2000, None), (2001, ""), (None, docs[0][1]), (2002, "  " + docs[0][1].upper()), (None, "alone")]
    want = components(docs)
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), most=most)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert 40 < len({c for _, c in want}) < len(docs)


def test_stage_keeps_one_of_each_component(spark):
    table = spark.createDataFrame(rows(), COLUMNS)
    kept = corpus_pipeline.near_dedup(spark, table, "")
    want = {c for _, c in components([(r[0], r[1]) for r in rows()])}
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} - {None} == want - {None}
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").collect() == []
