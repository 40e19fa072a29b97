"""Quality rules whose thresholds come from the data: per language and source, from mergeable
quantile sketches.

The sketch is a logarithmic histogram: a value falls into the bin ceil(log_g(value)), so any
quantile read from it is within ``ACCURACY`` of the true value, relatively. Bin counts add up,
so sketches merge by summing: across tasks (map-side combined), and from (language, source) to
language to everything, which serves groups too small to speak for themselves. Being counts,
they give the same thresholds in every run.

A rule rejects what lies beyond a fence. The upper fence starts from a high quantile of the
group and adds a multiple of its distance from the median; a lower fence does the same below.
Shares are zero for most texts, so only their upper quantiles tell groups apart. Junk spoils an
upper fence once it is more than ``1 - UPPER`` of the group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.registry import bounded, documents, query
from tidelog.llm.textstats import with_statistics
from tidelog.session import cut_lineage

ACCURACY = 0.01
_LOG_BASE = math.log((1 + ACCURACY) / (1 - ACCURACY))
#: Values below this count as zero, which has a bin of its own.
SMALLEST = 1e-6
#: Quantiles from which fences start.
LOWER, UPPER = 0.15, 0.85
_ZERO = -(2**31)


@dataclass(frozen=True)
class Rule:
    """A ratio of two counts, and how far beyond the outer quantile it may lie: ``widths`` times the
    distance from the median to that quantile, or ``least`` if that is more."""

    name: str
    over: str
    under: str
    least: float
    widths: float = 6.0
    both: bool = False


RULES = (
    Rule("symbol_share", "n_symbols", "word_chars", 0.03),
    Rule("dup_line_share", "n_dup_lines", "n_lines", 0.2),
    Rule("repeat_share", "n_repeat_words", "n_words", 0.05),
    Rule("mean_word", "word_chars", "n_words", 0.5, widths=3.0, both=True),
)


def bin_of(value: Column) -> Column:
    return F.when(value > SMALLEST, F.ceil(F.log(value) / F.lit(_LOG_BASE)).cast("int")).otherwise(F.lit(_ZERO))


def value_of(bin_: Column) -> Column:
    """Middle of a bin."""
    return F.when(bin_ == _ZERO, 0.0).otherwise(F.exp((bin_ - 0.5) * F.lit(_LOG_BASE)))


def sketches(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, bin, n): one sketch per key and value column. Null values are skipped."""
    named = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("value")) for v in values])
    return (
        rows.select(*keys, F.inline(named)).where(F.col("value").isNotNull())
        .groupBy(*keys, "metric", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser keys."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """(keys, metric, total, one column per rank). A window holds the bins of one sketch, a few thousand."""
    group = Window.partitionBy(*keys, "metric")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = sketch.withColumn("__upto", F.sum("n").over(upto)).withColumn("__total", F.sum("n").over(group))
    found = [
        value_of(F.min(F.when(F.col("__upto") >= F.col("__total") * F.lit(r), F.col("bin")))).alias(name)
        for name, r in ranks.items()
    ]
    return at.groupBy(*keys, "metric").agg(F.max("__total").alias("total"), *found)


def fences(stats: DataFrame, rules: tuple[Rule, ...], fewest: int) -> DataFrame:
    """(lang, source, ``<rule>_low``, ``<rule>_high``): a group with fewer than ``fewest`` rows
    takes the fences of its language, a language with too few those of all rows."""
    ranks = {"low": LOWER, "mid": 0.5, "top": UPPER}
    fine = cut_lineage(sketches(stats, ["__lang", "__source"], [r.name for r in rules]))
    coarse = merged(fine, ["__lang"])
    chosen = quantiles(fine, ["__lang", "__source"], ranks)
    by_lang = quantiles(coarse, ["__lang"], ranks).select("__lang", "metric", *[F.col(c).alias(f"{c}_l") for c in ("total", *ranks)])
    overall = quantiles(merged(coarse, []), [], ranks).select("metric", *[F.col(c).alias(f"{c}_a") for c in ("total", *ranks)])
    both = chosen.join(by_lang, ["__lang", "metric"]).join(overall, "metric")
    pick = lambda c: (
        F.when(F.col("total") >= fewest, F.col(c)).when(F.col("total_l") >= fewest, F.col(f"{c}_l")).otherwise(F.col(f"{c}_a"))
    )
    both = both.select("__lang", "__source", "metric", *[pick(c).alias(c) for c in ranks])
    made = []
    for rule in rules:
        beyond = lambda spread: F.greatest(spread * rule.widths, F.lit(rule.least))
        above, below = beyond(F.col("top") - F.col("mid")), beyond(F.col("mid") - F.col("low"))
        here = F.col("metric") == rule.name
        made.append(F.max(F.when(here, F.col("top") + above)).alias(f"{rule.name}_high"))
        made.append(F.max(F.when(here & F.lit(rule.both), F.col("low") - below)).alias(f"{rule.name}_low"))
    return both.groupBy("__lang", "__source").agg(*made)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    *,
    rules: tuple[Rule, ...] = RULES,
    fewest: int = 100,
) -> DataFrame:
    """Per row: id, language, source, the counts, ``base_failed``, the ratio and fences of each rule, ``kept``.

    ``base_failed`` means under 50 words, or more than half of the words in repeated windows of
    three. Such rows take no part in the sketches and are not kept. Null languages and sources
    are groups of their own. A null or empty text has no words and fails. Repeated rows are
    judged alike, each counts in the sketches. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    stats = with_statistics(rows, "text", ["doc_id", "lang", "source"], counts=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Kept as a table: read by the sketches and by the filter, written once from the texts.
    stats = cut_lineage(
        stats.withColumn("base_failed", failed).withColumns({
            r.name: F.when(~F.col("base_failed") & (F.col(r.under) > 0), F.col(r.over) / F.col(r.under)) for r in rules
        })
    )
    named = stats.withColumns({
        "__lang": F.struct(F.col("lang").isNull(), F.coalesce("lang", F.lit(""))).cast("struct<none:boolean,name:string>"),
        "__source": F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).cast("struct<none:boolean,name:string>"),
    })
    limits = bounded(cut_lineage(fences(named.where("not base_failed"), rules, fewest)))
    inside = ~F.col("base_failed")
    for r in rules:
        value = F.col(r.name)
        inside &= F.coalesce(value <= F.col(f"{r.name}_high"), F.lit(True)) & F.coalesce(value >= F.col(f"{r.name}_low"), F.lit(True))
    return named.join(limits, ["__lang", "__source"], "left").withColumn("kept", inside).drop("__lang", "__source")


@query("op1_adaptive_rules")
def op1_adaptive_rules(spark, sf_dir):
    found = quality_rules(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[r.name for r in RULES],
    )
