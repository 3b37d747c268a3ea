"""License scans by diagonal voting, in DataFrame operations alone.

The hashes of all rolling word k-grams of a text are matched with the k-grams of
license templates.  A match votes for the diagonal (text place - template place);
neighbouring diagonals are merged, and a span is verified by the share of the
template's k-grams that it holds word for word.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, others

K = 3
#: Diagonals this close (words inserted or left out) belong to one span.
SHIFT = 2
#: Share of a template's k-grams that a span must hold, the first and the last among them.
SHARE = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower-case words, K to K + 60 of them
    base: bool = False  # a phrase that counts only where all its words stand consecutively


TEMPLATES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("gpl-3", "licensed under the gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license version 3"),
    Template("mpl-2", "mozilla public license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("cc0", "to the extent possible under law all copyright and related rights are waived"),
)


def _template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """tpl, at, gram, h of each template k-gram; a table as small as the templates."""
    rows = []
    for i, t in enumerate(templates):
        words = t.text.split()
        if not K <= len(words) <= K + 60:
            raise ValueError(f"a template needs {K} to {K + 60} words: {t.text}")
        rows += [F.struct(F.lit(i).alias("tpl"), F.lit(j).alias("at"), *(F.lit(w).alias(f"w{x}") for x, w in enumerate(words[j : j + K]))) for j in range(len(words) - K + 1)]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    names = [f"w{x}" for x in range(K)]
    return one.select("tpl", "at", F.concat_ws(" ", *names).alias("gram"), F.xxhash64(*names).alias("h"))


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has __row, keep and n_words; spans has __row, tpl, label, base, first, last, share.

    Words are runs of non-ASCII characters, digits and letters, A-Z lower-cased; first
    and last count a span's words from 0.  Null texts have no words.  Repeated rows get
    a __row of their own.  All rolling k-grams are hashed in their row and semi-joined
    there with the templates' hashes; only hits leave the row, so no text is shuffled.
    """
    spark = docs.sparkSession
    grams = _template_grams(spark, templates)
    hashes = ", ".join(f"{r.h}L" for r in grams.select("h").distinct().collect())
    # lower() would also turn the Kelvin sign into an ASCII letter: another letter stands for it
    split = f"array_remove(split(lower(replace(coalesce(`{text}`, ''), 'K', 'Ⱪ')), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), '')"
    gram = ", ".join(f"w[i + {x}]" for x in range(K))
    found = (
        f"transform(array({split}), w -> named_struct('n', size(w), 'hits', CASE WHEN size(w) < {K} THEN array() ELSE "
        f"transform(filter(sequence(0, size(w) - {K}), i -> xxhash64({gram}) IN ({hashes})), "
        f"i -> named_struct('p', i, 'h', xxhash64({gram}), 'gram', concat_ws(' ', {gram}))) END))[0]"
    )
    rows = docs.select(*keep, F.expr(found).alias("__f"))
    rows = cut(rows.select(F.monotonically_increasing_id().alias("__row"), *keep, F.col("__f.n").cast("long").alias("n_words"), F.col("__f.hits").alias("__hits")), "grams")
    hits = rows.where(F.size("__hits") > 0).select("__row", F.explode("__hits").alias("x")).select("__row", "x.*")
    votes = (
        hits.join(F.broadcast(grams), ["h", "gram"])  # the templates are constants of the program
        .groupBy("__row", "tpl", (F.col("p") - F.col("at")).alias("diagonal"))
        .agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    )
    info = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(i).alias("tpl"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.text.split()) - K + 1).alias("size")) for i, t in enumerate(templates)))).alias("t")).select("t.*")
    votes = votes.join(F.broadcast(info), "tpl")
    # a text's matches of one template: sorted by diagonal, a gap of more than SHIFT starts another span
    w = Window.partitionBy("__row", "tpl").orderBy("diagonal")
    apart = F.when(F.col("base") | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > SHIFT), 1).otherwise(0)
    merged = (
        votes.withColumn("__apart", apart)
        .withColumn("__span", F.sum("__apart").over(w))
        .groupBy("__row", "tpl", "label", "base", "size", "__span")
        .agg(F.min("lo").alias("first"), (F.max("hi") + K - 1).alias("last"), F.bit_or("bits").alias("bits"))
        .withColumn("held", F.bit_count("bits"))
    )
    ends = F.expr("bits & 1 = 1 AND shiftright(bits, size - 1) & 1 = 1")  # a version at an end tells licenses apart
    merged = merged.withColumn("share", F.col("held") / F.col("size"))
    kept = merged.where(F.when(F.col("base"), F.col("held") == F.col("size")).otherwise(ends & (F.col("share") >= SHARE)))
    return rows.drop("__hits"), kept.select("__row", "tpl", "label", "base", F.col("first").cast("long"), F.col("last").cast("long"), "share")


def labels(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of docs.

    score is the largest verified share of a template (0 without spans).  A column in
    keep that has a result's name gives way to the result.
    """
    keep = others(keep, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    rows, spans = scan(docs, templates, text, keep)
    base = F.col("base")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  at most as many as there are labels
    found = spans.groupBy("__row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        join(F.when(base, F.col("label"))).alias("base_labels"),
        join("label").alias("labels"),
        F.max("share").alias("score"),
    )
    out = rows.join(found, "__row", "left")
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select(*keep, "n_words", fill("n_base", 0), "first_word", "last_word", fill("base_labels", ""), fill("labels", ""), fill("score", 0.0))
