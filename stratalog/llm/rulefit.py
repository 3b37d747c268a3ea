"""Sparse rule ensemble: tree paths become rules, a lasso logistic fit weighs them,
and the model is compiled into one Spark column expression over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, others
from .textstats import STATS, with_stats

#: Ratios that trees split on; plain counts of words and lines stay in.
FEATURES = {
    "n_words": "n_words",
    "n_lines": "n_lines",
    "word_len": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "pipes": "n_pipes / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "punct": "n_punct / greatest(n_words, 1)",
    "brackets": "n_brackets / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "short": "n_short / greatest(n_words, 1)",
    "long": "n_long / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}

Clause = tuple[int, bool, float]  # feature, True for "> threshold", threshold


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[tuple[Clause, ...], float], ...]

    def column(self) -> Column:
        """Probability of label 1, from the columns of FEATURES."""
        names = list(FEATURES)
        total: Column = F.lit(self.intercept)
        for clauses, weight in self.rules:
            test = None
            for f, above, at in clauses:
                one = F.col(names[f]) > F.lit(at) if above else F.col(names[f]) <= F.lit(at)
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int):
    """Leaves of a regression tree on gradients: (clauses, rows, value); splits by histogram."""
    todo, paths = [((), np.arange(len(g)))], []
    for level in range(depth + 1):
        nxt = []
        for clauses, rows in todo:
            if clauses:
                paths.append(clauses)
            best = (1e-9, None)
            if level < depth and len(rows) >= 2 * least:
                gs, hs = g[rows], h[rows]
                tot_g, tot_h = gs.sum(), hs.sum()
                for f, at in enumerate(cuts):
                    if not len(at):
                        continue
                    b = bins[rows, f]
                    n = len(at) + 1
                    cg, ch, cn = (np.cumsum(np.bincount(b, w, n))[:-1] for w in (gs, hs, np.ones(len(rows))))
                    gain = cg**2 / (ch + 1) + (tot_g - cg) ** 2 / (tot_h - ch + 1) - tot_g**2 / (tot_h + 1)
                    gain[(cn < least) | (len(rows) - cn < least)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), (f, int(gain.argmax())))
            if best[1] is None:
                yield clauses, rows, -g[rows].sum() / (h[rows].sum() + 1)
                continue
            f, k = best[1]
            low = bins[rows, f] <= k
            nxt += [((*clauses, (f, False, float(cuts[f][k]))), rows[low]), ((*clauses, (f, True, float(cuts[f][k]))), rows[~low])]
        todo = nxt
    yield paths, None, 0.0


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 2e-3, steps: int = 400) -> Model:
    """Boost shallow trees, take every node's path as a rule, keep what the lasso weighs.

    With no rows or one class the model is the smoothed base rate alone.
    """
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(p / (1 - p))), ())
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 34)[1:-1]))
        cuts.append(q[q < x[:, f].max()])
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(0)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple[Clause, ...], None] = {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        drawn = (rng.random(len(y)) < 0.5) * 1.0
        for clauses, rows, value in _grow(x, bins, cuts, g * drawn, h * drawn, depth, least):
            if rows is None:
                rules.update(dict.fromkeys(clauses))
            else:
                score[rows] += rate * value
    kept, columns, seen = [], [], set()
    for r in rules:
        hit = np.logical_and.reduce([x[:, f] > at if above else x[:, f] <= at for f, above, at in r])
        if (key := hit.tobytes()) not in seen and 0 < hit.sum() < len(y):
            seen.add(key)
            kept.append(r)
            columns.append(hit)
    if not kept:
        p = y.mean()
        return Model(float(np.log(p / (1 - p))), ())
    m = np.stack(columns, 1).astype(np.float32)
    w, b = _lasso(m, y, penalty, steps)
    return Model(b, tuple((r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-6))


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the mean logistic loss of standardised rules; no penalty on the intercept."""
    mean, sd = m.mean(0), m.std(0) + 1e-6
    z = (m - mean) / sd
    size = 1.0
    v = np.ones(z.shape[1], np.float32)
    for _ in range(15):
        v = z.T @ (z @ v)
        size = float(np.linalg.norm(v))
        v /= size
    step = 1 / (0.25 * size / len(y) + 0.25)
    w = w0 = np.zeros(z.shape[1])
    b = b0 = float(np.log(y.mean() / (1 - y.mean())))
    for i in range(steps):
        k = i / (i + 3)
        u, c = w + k * (w - w0), b + k * (b - b0)
        r = (1 / (1 + np.exp(-(z @ u.astype(np.float32) + c))) - y) / len(y)
        w0, b0 = w, b
        w = u - step * (z.T @ r.astype(np.float32))
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = c - step * r.sum()
    w = w / sd
    return w, float(b - (w * mean).sum())


def features(stats: DataFrame) -> DataFrame:
    """Replace STATS by FEATURES (double)."""
    keep = [c for c in stats.columns if c not in STATS]
    return stats.select(*keep, *(F.expr(e).cast("double").alias(f"{n}") for n, e in FEATURES.items()))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label: str = "quality", **kw) -> Model:
    """Fit on at most max_rows labelled rows (a bound on driver memory; drawn by hash of the id).

    Rows of held-out ids (crc32 of the id's text modulo 3 is 1), null ids and null
    labels teach nothing.
    """
    drawn = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of("doc_id", 3) != 1))
        .select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id", F.lit(7)), "__id", "__y")
        .limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").alias("__id"), F.col("text")).join(F.broadcast(drawn), "__id")
    table = features(with_stats(rows, keep=("__id", "__y"))).orderBy("__id", "__y").limit(max_rows).toPandas()
    return fit(table[list(FEATURES)].to_numpy(np.float64), table["__y"].to_numpy(np.float64), **kw)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, score (double, 0 to 1) and predicted (int); null and empty texts score as texts without words.

    Repeated rows each get a row.  A column in keep that has the name of a result, a
    statistic or a feature is left out.  A score of exactly 0.5 is predicted as 1.
    """
    keep = others(keep, ["score", "predicted", *STATS, *FEATURES])
    found = features(with_stats(docs, text, keep))
    return found.select(*keep, model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
