"""Rule bitmask ledger: each rule is judged once, policies are masks over the stored bits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others
from .textstats import with_stats


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule where the SQL condition over STATS holds."""

    name: str
    fails: str


#: Bit i of a ledger belongs to RULES[i]; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    # Up to 1,000 words a quarter must be distinct; beyond, the bound grows with the root of the length, as vocabularies do.
    Rule("stutter", "n_words >= 20 AND 16 * n_distinct * n_distinct < n_words * least(n_words, 1000)"),
)

#: Versioned policies: the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "stutter"),
}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[version])


def ledger(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the measurements, and fail_bits (long): bit i set where RULES[i] is broken.

    Null and empty texts have no words: they break few_words alone.  Repeated rows
    each get a row; columns not in keep are dropped, and one in keep with a result's
    name gives way to the result.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    value = reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")
    return with_stats(df, text, others(keep, ["fail_bits"])).withColumn("fail_bits", value)


def passes(version: int) -> Column:
    """Whether the ledger's row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0


def ablation(led: DataFrame, version: int) -> DataFrame:
    """Per rule of a policy: documents that break it, and those that it alone rejects.

    Rows are first counted by their bit pattern (at most 2 ** len(RULES) of them, on
    the map side), so the input's size and skew do not reach the second step.
    """
    by = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(version))).alias("bits")).count()
    names = [r.name for r in RULES]
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).cast("long").alias("bit")) for n in POLICIES[version]))
    hit = F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)
    alone = F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)
    return (
        by.select("bits", "count", F.explode(rows).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(F.sum(hit).alias("n_broken"), F.sum(alone).alias("n_alone"))
    )
