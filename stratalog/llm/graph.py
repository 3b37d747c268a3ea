"""Connected components by randomised contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """node, comp (long) for every end of edges(u, v) of different ends: equal comp means connected.

    Each round sends every vertex to the vertex within two steps that a fresh hash puts
    first, and contracts.  Stars vanish in one round, chains shrink by a constant factor
    in expectation, so rounds grow with the logarithm of the longest path at most.
    Minima are taken partly on the map side, so hubs cost nothing extra.  Self-loops
    and repeated edges change nothing.  edges is read twice: a table, not a computation.
    """
    left = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    steps, tables = [], []
    while not left.isEmpty() or not steps:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("x"))
        both = left.select("u", "v").union(left.select("v", "u"))
        near = both.groupBy("u").agg(F.min(order("v")).alias("b")).select("u", F.least("b", order("u")).alias("b"))
        far = both.join(near.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("b").alias("c"))
        to = cut(far.select(F.col("u").alias("old"), F.least("c", order("u"))["x"].alias("new")), "step", small=True)
        a, b = to.select(F.col("old").alias("u"), F.col("new").alias("x")), to.select(F.col("old").alias("v"), F.col("new").alias("y"))
        shrunk = left.join(a, "u").join(b, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        left = cut(shrunk, "edges", small=True)
        steps.append(to)
        tables += [to, left]
    labels = steps[0].select(F.col("old").alias("node"), F.col("new").alias("comp"))
    if len(steps) == 1:
        drop_cut(tables[1])
        return labels
    for to in steps[1:]:
        labels = labels.join(to.withColumnRenamed("old", "comp"), "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
    out = cut(labels, "labels", small=True)
    for t in tables:
        drop_cut(t)
    return out
