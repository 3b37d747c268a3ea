"""The core algebra: newest version wins, deletions hide, runs merge by precedence, scans are ordered."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lww(log: DataFrame, keys: str | Sequence[str] = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The newest version of each key, deletions (null values) included: keys, value, seq.

    Aggregates on the map side, so a key with many versions sends one row per task.  A
    filter on the keys above this is pushed below it, into the scan.
    """
    by = [keys] if isinstance(keys, str) else list(keys)
    return log.groupBy(*by).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def live(log: DataFrame, keys: str | Sequence[str] = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Keys and values that are not deleted; deletions are dropped after they have won, never before."""
    return lww(log, keys, value, seq).where(F.col(value).isNotNull()).drop(seq)


def joined(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """Full outer merge of two runs with one row a key: the left run's row wins, be it a deletion."""
    rest = [c for c in left.columns if c != key]
    wrap = lambda df, n: df.select(key, F.struct(*rest).alias(n))  # noqa: E731  a struct is never null where its row exists
    both = wrap(left, "l").join(wrap(right, "r"), key, "full_outer")
    return both.select(key, F.coalesce("l", "r").alias("x")).select(key, "x.*")


def merge_runs(runs: Sequence[DataFrame], key: str = "key", value: str = "value") -> DataFrame:
    """Merge of runs given from old to new: the newest run that has a key wins, deletions included."""
    if not runs:
        raise ValueError("no runs")
    ranked = [r.select(key, value, F.lit(i).alias("__rank")) for i, r in enumerate(runs)]
    every = reduce(DataFrame.unionByName, ranked)
    return every.groupBy(key).agg(F.max_by(value, "__rank").alias(value))


def between(df: DataFrame, lo=None, hi=None, key: str = "key") -> DataFrame:
    """Rows with lo <= key < hi; None leaves a side open."""
    if lo is not None:
        df = df.where(F.col(key) >= F.lit(lo))
    return df if hi is None else df.where(F.col(key) < F.lit(hi))


def scan(log: DataFrame, lo=None, hi=None, limit: int | None = None, key: str = "key") -> DataFrame:
    """Live rows of [lo, hi) in key order; with a limit the first so many (a top-k, not a full sort)."""
    out = between(live(log, key), lo, hi, key).orderBy(key)
    return out if limit is None else out.limit(limit)


def get(log: DataFrame, k, key: str = "key") -> DataFrame:
    """The live row of one key, or none."""
    return live(log.where(F.col(key) == F.lit(k)), key)


def multi_get(log: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """The live rows of the keys in wanted: a semi join before versions are resolved."""
    return live(log.join(wanted.select(key).distinct(), key, "left_semi"), key)


def tombstones(log: DataFrame, keys: str | Sequence[str] = "key") -> DataFrame:
    """Keys whose newest version is a deletion, and its seq."""
    return lww(log, keys).where(F.col("value").isNull()).drop("value")


def superseded(log: DataFrame, key: str = "key") -> DataFrame:
    """Versions that a newer one has replaced."""
    newest = log.groupBy(key).agg(F.max("seq").alias("__newest"))
    return log.join(newest, key).where(F.col("seq") < F.col("__newest")).drop("__newest")


def versions(log: DataFrame, key: str = "key") -> DataFrame:
    return log.groupBy(key).agg(F.count("*").alias("n_versions"), F.count("value").alias("n_values"))


def as_of(log: DataFrame, seq: int, key: str = "key") -> DataFrame:
    """Live rows as they were after a sequence number."""
    return live(log.where(F.col("seq") <= seq), key)


def recover_prefix(log: DataFrame, blocks: DataFrame, key: str = "key") -> DataFrame:
    """Live rows of a log's blocks before the first damaged one: log(block, ...), blocks(block, ok)."""
    bad = blocks.where(~F.col("ok")).agg(F.min("block").alias("__bad"))  # one row
    good = log.crossJoin(F.broadcast(bad)).where(F.col("__bad").isNull() | (F.col("block") < F.col("__bad")))
    return live(good, key)


def run_stats(runs: DataFrame, key: str = "key") -> DataFrame:
    """Per run: smallest and largest key, pairs, deletions, newest seq."""
    return runs.groupBy("run").agg(
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.count("*").alias("n_pairs"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_tombstones"),
        F.max("seq").alias("max_seq"),
    )


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the inclusive key ranges [a, b] and [c, d] meet."""
    return (a <= d) & (b >= c)


def range_overlaps(stats: DataFrame) -> DataFrame:
    """Pairs of runs whose key ranges meet.  Works on one row a run, so a nested loop is its natural plan."""
    a = stats.select(F.col("run").alias("run_a"), F.col("min_key").alias("lo_a"), F.col("max_key").alias("hi_a"))
    b = stats.select(F.col("run").alias("run_b"), F.col("min_key").alias("lo_b"), F.col("max_key").alias("hi_b"))
    return a.join(b, (F.col("run_a") < F.col("run_b")) & overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))).select("run_a", "run_b")


def largest_pair(stats: DataFrame, size: str = "n_pairs") -> DataFrame:
    """The two neighbouring runs (by run) of the largest total size; ties go to the first.  One row a run."""
    w = Window.orderBy("run")
    pairs = stats.select("run", F.lead("run").over(w).alias("next_run"), (F.col(size) + F.lead(size).over(w)).alias("size"))
    return pairs.where(F.col("next_run").isNotNull()).orderBy(F.desc("size"), "run").limit(1)
