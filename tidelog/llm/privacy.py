"""Personal data: overlapping candidate spans, boosted trees over their format and context,
calibrated thresholds.

Four strict patterns with their checks (address parts, Luhn sum, digit counts) give the base
spans, which always stay. Three loose generators propose further spans: runs of digits with
separators, addresses with spaces or a spelled-out @, and four numbers in a row. Boosted trees
score a proposal by what it looks like and what stands around it. They learn from the proposals
of all documents, those that a base span confirms against those that none does. One half of the
documents grows the trees; the other sets, per kind, the lowest score at which nearly all
proposals are right; a kind for which there is none adds nothing.

Features are whole numbers, so proposals that look alike are one row with a count. Trees and
thresholds need only sums over these rows: up to ``LOCAL`` of them are summed on the driver, more
in tasks, one job per level of a tree. Sums are whole numbers too, and both ways give one judge.

Finding and scoring are built-in functions over arrays inside each row: no text is shuffled.
Patterns avoid repeated scans of one run of characters, and positions are running sums over
the pieces between matches, so the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.registry import documents, query
from tidelog.llm.trees import Forest, grow, level_sums
from tidelog.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: One pattern per kind. Each equals the plain form without lookbehind and
#: possessive signs, which only keep the search from trying every character of a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]{1,3}+(?: ?[.,:-] ?[0-9]{1,3}+){3}(?![0-9])",
    "number": r"[0-9](?:[ ().-]{0,3}[0-9])++",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@|\\(at\\)|\\[at\\]", "ip": "[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "number": "[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
NEARBY = r"(?i)(?:tel|phone|fax|call|mobile|mail|contact|card|visa|account|iban|addr|host|server|\bip\b)"
BLOCK = 128
PRECISION = 0.98
FEATURES = 14
#: Values of a feature that are told apart; larger ones count as the largest.
BINS = 128
#: Steps between scores 0 and 1 on which a threshold may stand.
STEPS = 4096
#: Distinct proposals that the driver sums itself.
LOCAL = 50_000


def running(values: Column, step: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running sums (or maxima, minima) of an array of longs, in blocks so that appending does
    not copy the whole array each time."""

    def fold(block: Column) -> Column:
        return F.aggregate(
            block, F.array().cast("array<bigint>"),
            lambda done, x: F.concat(done, F.array(F.when(F.size(done) == 0, x).otherwise(step(F.get(done, F.size(done) - 1), x)))),
        )

    blocks = F.when(F.size(values) > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(values, b * BLOCK + 1, BLOCK))
    ))
    ends = fold(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(ends, 1, F.size(ends) - 1))
    # Zipped, not looked up: what stands inside a lambda is computed again for every element.
    return F.flatten(F.zip_with(blocks, before, lambda b, c: F.transform(b, lambda x: F.when(c.isNull(), x).otherwise(step(c, x)))))


def located(df: DataFrame, text: str, name: str, pattern: str, hint: str) -> DataFrame:
    """``df`` with ``name``: the matches as (start, end, text, before, after), in code points."""
    m, p, r = f"{name}__m", f"{name}__p", f"{name}__r"
    return (
        df.withColumn(m, F.when(F.col(text).rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        .withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
        .withColumn(r, F.when(F.size(m) > 0, running(F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(p, i))).cast("bigint")))))
        .withColumn(name, F.when(F.size(m) > 0, F.transform(m, lambda x, i: F.struct(
            (F.get(r, i) - F.length(x)).alias("start"), F.get(r, i).alias("end"), x.alias("text"),
            F.right(F.get(p, i), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(8)).alias("after"),
        ))))
        .drop(m, p, r)
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the weighted digit sum of a string of digits ends in 0."""
    value = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(number)), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2),
    )
    return total % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The check that a match of a strict pattern must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(OCTETS)
    n = F.length(digits(text))
    return n.between(12, 19) & luhn(digits(text)) if kind == "card" else n.between(9, 15)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``base``: spans (start, rank, end) of all kinds, sorted."""
    for kind in KINDS:
        df = located(df, text, f"__{kind}", PATTERNS[kind], HINTS[kind])
    parts = [
        F.coalesce(
            F.transform(
                F.filter(f"__{kind}", lambda s: valid(kind, s["text"])),
                lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")),
            ),
            F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"),
        )
        for rank, kind in enumerate(KINDS)
    ]
    return df.withColumn("base", F.array_sort(F.concat(*parts))).drop(*[f"__{k}" for k in KINDS])


def features(span: Column) -> Column:
    """Format and context of a proposed span, as FEATURES doubles."""
    text, before, after = span["text"], span["before"], span["after"]
    number = digits(text)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    return F.array(
        size(number),
        size(F.regexp_replace(text, "[^A-Za-z]", "")),
        size(text),
        size(F.regexp_replace(text, "[^ ().-]", "")),
        flag(before.rlike(r"\+\(?$")),
        size(F.regexp_replace(text, "[^@]", "")),
        F.size(F.split(text, "[0-9]+", -1)).cast("double"),
        size(F.regexp_replace(text, "[^.]", "")),
        flag(before.rlike(r"[A-Za-z0-9_]$")),
        flag(after.rlike(r"^[A-Za-z0-9_]")),
        flag(before.rlike(NEARBY)),
        flag(before.rlike(r"[=\"'#/]\s*$")),
        flag(F.length(number).between(12, 19) & luhn(number)),
        flag(text.rlike(OCTETS)),
    )


def proposals(df: DataFrame, text: str) -> DataFrame:
    """``df`` (with ``base``) with ``__proposed``: (rank, start, end, x, confirmed) of all loose
    matches, confirmed if a base span overlaps.

    Base spans and matches are lined up by start: a match is overlapped by the farthest end
    before it or by the nearest start after it, both running values."""
    for name in LOOSE:
        df = located(df, text, f"__{name}", LOOSE[name], HINTS[name])
    rank = {"email": lambda s: F.lit(0), "ip": lambda s: F.lit(1),
            "number": lambda s: F.when(F.length(digits(s["text"])) >= 12, 2).otherwise(3)}
    kind = "array<struct<start:bigint,side:int,end:bigint,rank:int,text:string,before:string,after:string>>"
    lined = [
        F.coalesce(
            F.transform(
                F.filter(f"__{name}", lambda s: F.lit(True) if name != "number" else F.length(digits(s["text"])) >= 7),
                lambda s: F.struct(s["start"], F.lit(1), s["end"], rank[name](s), s["text"], s["before"], s["after"]),
            ).cast(kind),
            F.array().cast(kind),
        )
        for name in LOOSE
    ]
    none = F.lit(None).cast("string")
    known = F.transform("base", lambda b: F.struct(b["start"], F.lit(0), b["end"], b["rank"], none, none, none)).cast(kind)
    far = F.lit(1 << 60).cast("bigint")
    return (
        df.withColumn("__line", F.array_sort(F.concat(*lined)))
        .withColumn("__line", F.when(F.size("__line") > 0, F.array_sort(F.concat(known, F.col("__line")))))
        .withColumn("__ends", running(F.transform("__line", lambda e: F.when(e["side"] == 0, e["end"]).otherwise(-1)), F.greatest))
        .withColumn("__starts", F.reverse(running(
            F.reverse(F.transform("__line", lambda e: F.when(e["side"] == 0, e["start"]).otherwise(far))), F.least)))
        .withColumn("__line", F.arrays_zip("__line", "__ends", "__starts"))
        .withColumn("__proposed", F.coalesce(
            F.transform(F.filter("__line", lambda z: z["__line"]["side"] == 1), lambda z: F.struct(
                z["__line"]["rank"].alias("rank"), z["__line"]["start"].alias("start"), z["__line"]["end"].alias("end"),
                features(z["__line"]).alias("x"),
                ((z["__ends"] > z["__line"]["start"]) | (z["__starts"] < z["__line"]["end"])).alias("confirmed"),
            )),
            F.array().cast("array<struct<rank:int,start:bigint,end:bigint,x:array<double>,confirmed:boolean>>"),
        ))
        .drop("__line", "__ends", "__starts", *[f"__{n}" for n in LOOSE])
    )


@dataclass(frozen=True)
class Judge:
    forest: Forest
    #: Lowest score that redacts, per kind; infinite where none is right often enough.
    cuts: tuple[float, ...]


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, confirmed, count, rank) of distinct proposals."""
    x = table.column("x")
    x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False)
    confirmed, count, rank = (table.column(c).to_numpy(**({} if isinstance(table, pa.Table) else {"zero_copy_only": False})) for c in ("confirmed", "n", "rank"))
    return x.reshape(-1, FEATURES).astype(np.int64), confirmed.astype(np.int64), count.astype(np.int64), rank.astype(np.int64)


def _summing(rows: DataFrame) -> Callable[[Callable[..., np.ndarray]], np.ndarray]:
    """How to sum a function of distinct proposals over all of ``rows``: it takes their arrays and gives
    an array of whole numbers, whose size does not depend on them."""
    names = ["x", "confirmed", "n", "rank"]
    if rows.count() <= LOCAL:
        local = _arrays(rows.select(*names).toArrow())
        return lambda part: part(*local)

    def spread(part: Callable[..., np.ndarray]) -> np.ndarray:
        shape = part(*(np.zeros(size, np.int64) for size in ((0, FEATURES), 0, 0, 0))).shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for batch in batches:
                total += part(*_arrays(batch))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], ["at", "v"])

        out = np.zeros(int(np.prod(shape)), np.int64)
        # One row per cell of the result.
        for r in rows.select(*names).mapInArrow(run, "at bigint, v bigint").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(shape)

    return spread


def fit_judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, precision: float = PRECISION) -> Judge:
    """Trees and thresholds from the proposals in all documents.

    Proposals that only a scored decision could add are what base spans do not confirm; a
    threshold lets through few enough of those. With no proposals nothing is added."""
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__text"))
    # Written first: exploding the expression itself would make the optimiser repeat it per field.
    found = cut_lineage(proposals(base_spans(texts, "__text"), "__text").select("__id", "__proposed"))
    alike = F.transform("c.x", lambda v: F.least(v, F.lit(BINS - 1.0)).cast("int")).alias("x")
    rows = cut_lineage(
        found.select(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(2)).alias("half"), F.explode("__proposed").alias("c"))
        .select("half", "c.rank", alike, "c.confirmed").groupBy("half", "rank", "x", "confirmed").agg(F.count("*").alias("n"))
    )
    learn, hold = (_summing(rows.where(F.col("half") == half)) for half in (0, 1))
    no, yes = learn(lambda x, y, n, rank: np.array([(n * (1 - y)).sum(), (n * y).sum()]))
    forest = grow(
        lambda *tree: learn(lambda x, y, n, rank: level_sums(x, y, n, *tree, BINS)), int(no), int(yes), FEATURES, BINS, rounds=30, depth=3
    )

    def counted(x, y, n, rank) -> np.ndarray:
        """Proposals by kind and step of the score, and how many of them are right."""
        at = rank * (STEPS + 1) + np.floor(forest.score(x) * STEPS).astype(np.int64)
        return np.stack([np.bincount(at, w, len(KINDS) * (STEPS + 1)).astype(np.int64) for w in (n, n * y)])

    cuts = []
    for total, right in hold(counted).reshape(2, len(KINDS), STEPS + 1).swapaxes(0, 1):
        good = (total > 0) & (right[::-1].cumsum()[::-1] >= precision * (total[::-1].cumsum()[::-1] + 1))
        cuts.append(float(np.flatnonzero(good)[0] / STEPS) if good.any() else float("inf"))
    return Judge(forest, tuple(cuts))


def score(forest: Forest, x: Column) -> Column:
    """The forest's probability as an expression: its flat arrays, walked level by level."""
    trees, inner, leaves = len(forest.leaf), 2**forest.depth - 1, 2**forest.depth
    if not trees:
        return F.lit(1.0 / (1.0 + float(np.exp(-forest.base))))
    literal = lambda a, kind: F.split(F.lit(",".join(map(repr, a.ravel().tolist()))), ",").cast(f"array<{kind}>")
    which, limit, value = literal(forest.feature, "int"), literal(np.minimum(forest.threshold, 1e300), "double"), literal(forest.leaf, "double")

    def leaf(tree: Column) -> Column:
        step = lambda node, _: (
            2 * node + 1 + (F.get(x, F.get(which, tree * inner + node)) > F.get(limit, tree * inner + node)).cast("int")
        )
        return F.get(value, tree * leaves - inner + F.aggregate(F.sequence(F.lit(1), F.lit(forest.depth)), F.lit(0), step))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(forest.base), lambda s, t: s + leaf(t))
    return 1 / (1 + F.exp(-total))


def find_personal_data(docs: DataFrame, judge: Judge | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, rank, end), ``rank`` counting in
    ``KINDS``, offsets in code points from 0, ends exclusive, sorted.

    ``spans`` holds the base and what the judge adds beside it. Added spans overlap neither base
    spans nor one another; of two that would, the higher score stays, then the earlier. A null text counts
    as empty and has no spans. Columns named like the added ones are replaced; rows are kept as
    they are, repeated or not.
    """
    docs = docs.drop("base", "spans")
    judge = judge or fit_judge(docs, id_col, text_col)
    found = proposals(base_spans(docs.withColumn("__text", F.coalesce(text_col, F.lit(""))), "__text"), "__text")
    cut = F.array(*[F.lit(min(c, 2.0)) for c in judge.cuts])
    fresh = F.transform(
        F.filter("__proposed", lambda c: ~c["confirmed"]),
        lambda c: F.struct(score(judge.forest, c["x"]).alias("score"), c["start"].alias("start"), c["end"].alias("end"), c["rank"].alias("rank")),
    )
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (F.struct(a["start"], a["rank"], a["end"]) < F.struct(b["start"], b["rank"], b["end"])))
    return (
        found.withColumn("__fresh", F.filter(fresh, lambda c: c["score"] >= F.get(cut, c["rank"])))
        .withColumn("__fresh", F.filter("__fresh", lambda c: ~F.exists(
            "__fresh", lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & better(o, c))))
        .withColumn("spans", F.array_sort(F.concat("base", F.transform(
            "__fresh", lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))))))
        .select(*docs.columns, "base", "spans")
    )


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, judge: Judge | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null.

    Of overlapping base spans the first gives its name, and the rest of the others goes too."""
    found = find_personal_data(docs, judge, id_col, text_col)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        upto = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        name = F.when(s["start"] >= state["at"], F.get(names, s["rank"])).otherwise("")
        return F.struct(F.concat(state["done"], upto, name).alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    end = F.aggregate("spans", start, step)
    rest = F.substring(text, (end["at"] + 1).cast("int"), F.length(text))
    clean = F.when(F.size("spans") > 0, F.concat(end["done"], rest)).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])


@query("op2_personal_data")
def op2_personal_data(spark, sf_dir):
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda s: s["rank"] == r)).cast("bigint").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
