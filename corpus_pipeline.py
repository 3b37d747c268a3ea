"""Corpus pipeline: each stage is one corpus operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import bpe, decontam, ledger, neardup, rulefit
from stratalog.llm.common import cut, table
from stratalog.llm.queries import WORD_BPE


def _plain(docs: DataFrame) -> tuple[DataFrame, str, Callable[[DataFrame], DataFrame]]:
    """docs under column names that no operator uses, its text's name, and the way back to docs' own columns."""
    safe = [f"__c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*safe), safe[docs.columns.index("text")], lambda out: out.select(*safe).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy passes; null, empty and very short texts do not."""
    safe, text, back = _plain(docs)
    return back(ledger.ledger(safe, text, tuple(safe.columns)).where(ledger.passes(ledger.CURRENT)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of good quality.  The model learns from labelled rows of
    the whole documents table, whose junk the stage before has already taken out of docs."""
    model = rulefit.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    safe, text, back = _plain(docs)
    return back(rulefit.score(safe, model, tuple(safe.columns), text).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window at all: every affected document goes, however small its share of hits."""
    safe, text, back = _plain(docs)
    return back(decontam.search(safe, table(spark, sf_dir, "benchmark"), text).where(F.col("n_hit") == 0))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text."""
    return bpe.encode(docs, WORD_BPE, digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: SQL has neither the classifier's fit nor the tokenizer; a brute-force version in the tests takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
