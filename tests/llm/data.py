"""A small table with what operators must bear: nulls, empty and long texts, copies, repeated rows, clashing names."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, shard int, size long, runs int, id string, weight int, proposed string"


def rows(seed=1, n=60):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choice("abcdefgé") for _ in range(pick.randint(2, 8))) for _ in range(300)]
    passage = " ".join(pick.choice(vocabulary) for _ in range(70))
    out = []
    for i in range(n):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 120))]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        if i % 5 == 0:
            text += "\n" + passage
        out.append((i, text, pick.choice(["en", "de", None]), pick.choice(["a", "b", None, "é"]), len(text)))
    out += [(100, out[3][1], "en", "a", 1), (101, out[3][1], None, None, None), (102, None, "en", "a", 0), (103, "", None, "b", 0)]
    out += [(104, " ".join(vocabulary) * 40, "en", "a", 9), (105, "x" * 30_000, "en", "b", 9), (106, "a b c\n" * 400, "en", "b", 9)]
    out += [out[7], (None, "no id at all", "en", "a", 3), (None, out[5][1], "en", "a", 3), (107, out[5][1] + " end", "en", "a", 3)]
    return [(*r, False, 0.25, 7, 9, 4, "own", 5, "mine") for r in out]


def table(spark, **options):
    return spark.createDataFrame(rows(**options), COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
