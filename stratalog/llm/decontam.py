"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each shard (a block of documents within a partition) gets a word-level suffix array.
Every benchmark suffix is binary-searched in it: the neighbours of its place give the
longest verbatim match and where it is, and the range of suffixes that begin with a
whole window gives all the window's occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, BLOCK_BYTES, BROADCAST_BYTES, blocks, cut, drop_cut, others, small_batches, split_words, utf8

WINDOW = 13
#: Text bytes of a shard for benchmarks of many words, each of which is searched in every shard.
SHARD_BYTES, MANY_WORDS = 12 << 20, 200_000


class Benchmark:
    """Items as word numbers; every suffix of an item is a query."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int) -> None:
        words, counts = split_words(texts, ALNUM)
        self.vocab = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
        self.bits = max(1, len(self.vocab).bit_length())
        self.per_key = max(1, 62 // self.bits)
        self.ids = [i for i, n in zip(ids, counts, strict=True) if n]
        counts = counts[counts > 0]
        total = int(counts.sum())
        ends = np.cumsum(counts + 1) - 1
        seq = np.zeros(total + len(counts), np.int64)
        inside = np.ones(len(seq), bool)
        inside[ends] = False
        seq[inside] = np.fromiter(map(self.vocab.__getitem__, words), np.int64, total)
        self.starts = np.flatnonzero(inside)
        self.item = np.repeat(np.arange(len(counts)), counts)
        self.left = np.repeat(ends, counts) - self.starts  # words from here to the item's end
        self.offset = self.starts - np.repeat(ends - counts, counts)
        self.size = np.where(self.offset == 0, np.minimum(np.repeat(counts, counts), window), window)
        self.longest = int(counts.max()) if len(counts) else 0
        self.keys = packed(seq, runs(seq), self.bits, self.per_key)
        self.seq = seq


def runs(seq: np.ndarray) -> np.ndarray:
    """How many non-zero entries follow from each place on."""
    n = len(seq)
    stop = np.where(seq == 0, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n) if n else stop


def packed(seq: np.ndarray, run: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The first k words from each place in one integer; nothing beyond a zero counts."""
    out = np.zeros(len(seq), np.int64)
    for j in range(k):
        out <<= bits
        m = len(seq) - j
        if m > 0:
            out[:m] |= np.where(run[:m] > j, seq[j:], 0)
    return out


class SuffixArray:
    """Suffixes of seq that begin with a known word, ordered by their first depth words at least."""

    def __init__(self, seq: np.ndarray, bits: int, k: int, depth: int) -> None:
        self.seq, self.bits, self.k = seq, bits, k
        self.run = runs(seq)
        self.keys = packed(seq, self.run, bits, k)
        at = np.flatnonzero(seq)
        key = self.keys[at]
        order = np.argsort(key)
        at, key = at[order], key[order]
        n = len(at)
        rank = np.zeros(len(seq), np.int64)
        head = np.zeros(n, np.int64)  # slot where each suffix's group of equals begins
        if n:
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[at] = head + 1
        h = k
        while h < depth and n:
            tied = np.zeros(n, bool)
            tied[1:] = head[1:] == head[:-1]
            tied[:-1] |= tied[1:].copy()
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            here, group = at[slots], head[slots]
            ahead = np.minimum(here + h, len(seq) - 1)
            second = np.where(self.run[here] > h, rank[ahead], 0)
            both = group * (n + 1) + second
            order = np.argsort(both, kind="stable")
            here, both = here[order], both[order]
            fresh = np.concatenate([[True], both[1:] != both[:-1]])
            at[slots] = here
            head[slots] = np.maximum.accumulate(np.where(fresh, slots, 0))
            rank[here] = head[slots] + 1
            h *= 2
        self.at = at

    def _before(self, at: np.ndarray, bench: Benchmark, q: np.ndarray, size: np.ndarray, also_equal: bool) -> np.ndarray:
        """Whether the first size words of suffixes at come before those of queries q (or equal them)."""
        out = np.full(len(q), also_equal)
        todo, done = np.arange(len(q)), 0
        while len(todo):
            a = np.minimum(at[todo] + done, len(self.keys) - 1)
            ours = np.where(self.run[at[todo]] > done, self.keys[a], 0)
            theirs = bench.keys[np.minimum(q[todo] + done, len(bench.keys) - 1)]
            cut = np.maximum(self.k - (size[todo] - done), 0) * self.bits
            ours, theirs = ours >> cut, theirs >> cut
            out[todo] = np.where(ours == theirs, also_equal, ours < theirs)
            done += self.k
            todo = todo[(ours == theirs) & (size[todo] > done)]
        return out

    def search(self, bench: Benchmark, q: np.ndarray, size: np.ndarray, also_equal: bool = False) -> np.ndarray:
        """First slot whose suffix does not come before each query's first size words (or, with also_equal, comes after)."""
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(self.at), np.int64)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._before(self.at[mid], bench, q[todo], size[todo], also_equal)
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def common(self, bench: Benchmark, q: np.ndarray, slot: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that queries share with the suffixes in slots (0 outside the array)."""
        out = np.zeros(len(q), np.int64)
        todo = np.flatnonzero((slot >= 0) & (slot < len(self.at)))
        at, done = self.at[np.clip(slot, 0, max(len(self.at) - 1, 0))] if len(self.at) else slot, 0
        while len(todo):
            ok = (size[todo] > done) & (self.run[at[todo]] > done)
            todo = todo[ok]
            same = self.seq[at[todo] + done] == bench.seq[q[todo] + done]
            todo = todo[same]
            out[todo] += 1
            done += 1
        return out


def search_shard(bench: Benchmark, words: list[bytes], counts: np.ndarray) -> dict:
    """Longest match of every benchmark suffix in a shard, and all hits of whole windows.

    spans: (text, first word, end) of each occurrence; items: (text, item) pairs, distinct.
    """
    n_docs = len(counts)
    first = np.cumsum(counts + 1) - counts - 1  # a zero ends each text
    seq = np.zeros(int(counts.sum()) + n_docs, np.int64)
    place = np.arange(int(counts.sum())) + np.repeat(np.arange(n_docs), counts)
    look = bench.vocab.get
    seq[place] = np.fromiter((look(w, 0) for w in words), np.int64, len(words))
    sa = SuffixArray(seq, bench.bits, bench.per_key, bench.longest)
    q, none = bench.starts, np.zeros(0, np.int64)
    out = {"length": np.zeros(len(q), np.int64), "at": np.full(len(q), -1), "spans": (none, none, none), "items": (none, none)}
    if not len(q) or not len(sa.at):
        return out
    slot = sa.search(bench, q, bench.left)
    below, here = sa.common(bench, q, slot - 1, bench.left), sa.common(bench, q, slot, bench.left)
    out["length"] = np.maximum(below, here)
    best = np.where(below > here, slot - 1, slot)
    out["at"] = np.where(out["length"] > 0, sa.at[np.clip(best, 0, len(sa.at) - 1)], -1)
    doc_at = lambda p: np.searchsorted(first, p, side="right") - 1
    out["doc"] = np.where(out["at"] >= 0, doc_at(out["at"]), -1)
    out["word"] = np.where(out["at"] >= 0, out["at"] - first[np.maximum(out["doc"], 0)], -1)

    w = np.flatnonzero((bench.size <= bench.left) & (out["length"] >= bench.size))
    if not len(w):
        return out
    lo, hi = sa.search(bench, q[w], bench.size[w]), sa.search(bench, q[w], bench.size[w], True)
    # the same window of several items is one range: expand it once
    ranges, which = np.unique(np.stack([lo, hi, bench.size[w]], 1), axis=0, return_inverse=True)
    which = which.ravel()
    n = ranges[:, 1] - ranges[:, 0]
    group = np.repeat(np.arange(len(ranges)), n)
    p = sa.at[np.repeat(ranges[:, 0], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    doc = doc_at(p)
    start = p - first[doc]
    out["spans"] = (doc, start, start + ranges[group, 2])
    by_group: list[set[int]] = [set() for _ in ranges]
    for g, i in zip(which.tolist(), bench.item[w].tolist(), strict=True):
        by_group[g].add(i)
    found: dict[int, set[int]] = {}
    for d, g in np.unique(np.stack([doc, group], 1), axis=0).tolist():
        found.setdefault(d, set()).update(by_group[g])
    pairs = [(d, i) for d, s in found.items() for i in s]
    out["items"] = tuple(np.array(x, np.int64) for x in zip(*pairs, strict=True))
    return out


def item_blocks(bench: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[tuple[list[str], list[bytes]]]:
    """Benchmark items in blocks of at most limit text bytes (or one item), so that any size can be searched."""
    ids, texts, size = [], [], 0
    rows = bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for row in rows.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        raw = row.t.encode()
        if ids and size + len(raw) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(raw)
        size += len(raw)
    if ids:
        yield ids, texts


def search(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW, limit: int = BROADCAST_BYTES) -> DataFrame:
    """All columns of docs, then n_words, n_hit (long), items (sorted array of item ids as text), spans, contaminated.

    spans holds the merged word ranges [start, end) that occurrences cover.  Null texts
    have no words; items without id or words match nothing; repeated rows each get a
    row; an empty benchmark hits nothing.  Columns of docs with the new names are
    replaced, but the text is read first, whatever its name.  One pass and no shuffle for
    each block of the benchmark.  The driver holds one block: before it reads the next,
    the rows so far are written to the shared folder and the block's broadcast is destroyed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ["n_words", "n_hit", "items", "spans", "contaminated"]
    keep = others(docs.columns, made)
    safe = [f"c{i}" for i in range(len(keep))]
    df = docs.select(*(docs[c].alias(s) for c, s in zip(keep, safe, strict=True)), docs[text].alias("__text"))
    df = df.withColumns({"__items": F.array().cast("array<string>"), "__spans": F.array().cast("array<long>"), "__n": F.lit(0).cast("long")})
    shared, before = None, None
    for block in item_blocks(bench, limit):
        if shared:
            df = cut(df, "hits")
            shared.destroy()
            if before is not None:
                drop_cut(before)
            before = df
        shared = spark.sparkContext.broadcast(block)
        df = df.mapInArrow(_pass(shared, window), df.schema)
    if not shared:
        df = df.mapInArrow(_pass(spark.sparkContext.broadcast(([], [])), window), df.schema)
    spans: Column = F.expr(
        "CASE WHEN size(__spans) = 0 THEN cast(array() AS array<struct<start:bigint,end:bigint>>) ELSE "
        "transform(sequence(0, cast(size(__spans) div 2 AS int) - 1), i -> struct(__spans[2 * i] AS start, __spans[2 * i + 1] AS end)) END"
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    back = [F.col(s).alias(c) for c, s in zip(keep, safe, strict=True)]
    out = df.select(*back, F.col("__n").alias("n_words"), F.col("__items").alias("items"), spans.alias("spans")).withColumn("n_hit", hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(*keep, *made)


def _shard(bench: Benchmark) -> int:
    """Text bytes of a shard."""
    return SHARD_BYTES if len(bench.starts) > MANY_WORDS else BLOCK_BYTES


def _pass(shared, window: int):
    """A pass over blocks of documents (last columns: text, items, spans, words) that adds what one block of items hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        bench = Benchmark(ids, texts, window)
        for block in blocks(batches, _shard(bench)):
            words, counts = split_words(utf8(block.column("__text")), ALNUM)
            got = search_shard(bench, words, counts)
            items = block.column("__items").to_pylist()
            spans = block.column("__spans").to_pylist()
            for d, i in zip(*(x.tolist() for x in got["items"]), strict=True):
                items[d].append(bench.ids[i])
            for d in set(got["items"][0].tolist()):
                items[d] = sorted(set(items[d]))
            doc, start, end = got["spans"]
            order = np.lexsort((start, doc))
            new: dict[int, list[tuple[int, int]]] = {}
            for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
                new.setdefault(d, []).append((s, e))
            for d, more in new.items():
                spans[d] = merged([*zip(spans[d][::2], spans[d][1::2], strict=True), *more])
            rest = [pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64())), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*block.columns[:-3], *rest], names=block.schema.names)

    return run


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    """Union of ranges as start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def longest_matches(docs: DataFrame, bench: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Per item (text id): its longest verbatim match in all documents - item_id, length, item_word, doc_word and the document.

    Every shard reports its best match of each item; the best of all shards is a max
    over those rows (ties: the earliest item word, then the smallest id).  Items that
    share no word with any document have no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("t"))
    parts = []
    for ids, texts in item_blocks(bench, limit):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = Benchmark(*shared.value, WINDOW)
            for block in blocks(batches, _shard(b)):
                names = block.column(0).to_pylist()
                got = search_shard(b, *split_words(utf8(block.column(1)), ALNUM))
                if "doc" not in got:
                    continue
                order = np.lexsort((b.offset, -got["length"], b.item))
                head = np.concatenate([[True], b.item[order][1:] != b.item[order][:-1]])
                rows = [r for r in order[head].tolist() if got["length"][r] > 0]
                cols = [[b.ids[b.item[r]] for r in rows], got["length"][rows], b.offset[rows], got["word"][rows], [names[got["doc"][r]] for r in rows]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["item_id", "length", "item_word", "doc_word", "doc"])

        parts.append(source.mapInArrow(run, "item_id string, length long, item_word long, doc_word long, doc string"))
    if not parts:
        return spark.createDataFrame([], f"item_id string, length long, item_word long, doc_word long, {doc} string")
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    best = F.min(F.struct((-F.col("length")).alias("l"), "item_word", "doc", "doc_word")).alias("b")
    return every.groupBy("item_id").agg(best).select("item_id", (-F.col("b.l")).alias("length"), "b.item_word", "b.doc_word", F.col("b.doc").alias(doc))
