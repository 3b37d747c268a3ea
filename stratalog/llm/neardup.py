"""Near-duplicate groups: SetSketch bands propose links, likelihood screens, full sets verify.

Texts with the same shingle set are one node.  Nodes meet in the buckets of their
register bands.  First every node is compared with its bucket's first node; linked
nodes are merged into components.  Buckets that still hold several components are
then compared in blocks of bounded size - only across components, and only until two
components are linked - so no group's pairs are ever listed and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, blocks, cut, drop_cut, small_batches, utf8
from .graph import components
from .setsketch import BANDS, M, buckets, fingerprint, first_band, reaches, shingle_sets, sketches

#: Similarity of linked sets, in percent, and how far below it an estimate is still verified (5 standard errors).
PERCENT = 80
SLACK = 5 * (0.8 * 0.2 / M) ** 0.5
#: Nodes on either side of a block of comparisons.
BLOCK = 512


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def sketch_rows(docs: DataFrame, text: str, k: int, keep: tuple[str, ...]) -> DataFrame:
    """keep, n (size of the shingle set), fp (fingerprint of the set), regs (registers); null for empty sets."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]), "n long, fp binary, regs binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches):
            sets = shingle_sets(utf8(block.column(block.num_columns - 1)), hashes, k)
            regs = sketches(sets)
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *made], names=[*keep, "n", "fp", "regs"])

    return source.mapInArrow(run, schema)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        b = buckets(_regs(block.column(1)))
        nodes = np.repeat(_long(block.column(0)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(b.ravel().view(np.int64)), pa.array(nodes)], names=["bucket", "node"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, nu, ru, v, nv, rv) whose estimated similarity may reach the limit."""
    for block in blocks(batches):
        na, nb = _long(block.column(1)), _long(block.column(4))
        fits = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        a, b = _regs(block.column(2)), _regs(block.column(5))
        at = np.flatnonzero(fits & reaches(PERCENT / 100 - SLACK, (a > b).sum(1), (a < b).sum(1), na, nb))
        yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(at)), block.column(3).take(pa.array(at))], names=["u", "v"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, su, v, sv) whose full sets are similar enough."""
    for block in blocks(batches):
        a, b = block.column(1).to_pylist(), block.column(3).to_pylist()
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)]
        at = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([block.column(0).take(at), block.column(2).take(at)], names=["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal first three columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([_long(batch.column(i)) for i in range(3)], 1)
        cut_at = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        edges = [0, *cut_at.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(key[a])
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _candidates(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (a, b) of a group that still have to be verified, their equal registers, and all rows' components.

    A pair that shares several buckets is a candidate in that of its first common band alone.
    """
    i, j, band = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("bucket")[0].as_py() & 31
    comp, n, x = (_long(group.column(c).combine_chunks()) for c in ("comp", "n", "x"))
    none = np.zeros(0, np.int64)
    if (comp == comp[0]).all():
        return none, none, none, comp
    regs = _regs(group.column("regs"))
    left, right = np.flatnonzero(x == i), np.flatnonzero(x == j)
    found: list[tuple[np.ndarray, ...]] = []
    for a in left:
        b = right[right > a] if i == j else right
        b = b[(comp[b] != comp[a]) & (100 * np.minimum(n[b], n[a]) >= PERCENT * np.maximum(n[b], n[a]))]
        if not len(b):
            continue
        equal = regs[b] == regs[a]
        here = first_band(equal) == band
        b, equal = b[here], equal[here]
        found.append((np.full(len(b), a), b, (regs[a] > regs[b]).sum(1), equal.sum(1)))
    if not found:
        return none, none, none, comp
    a, b, above, same = (np.concatenate(c) for c in zip(*found, strict=True))
    may = reaches(PERCENT / 100 - SLACK, above, M - above - same, n[a], n[b])
    return a[may], b[may], same[may], comp


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of block groups that have a candidate in another component."""
    for group in _groups(batches):
        a, b, _, _ = _candidates(group)
        rows = np.unique(np.concatenate([a, b]))
        if len(rows):
            yield from group.take(pa.array(rows)).combine_chunks().to_batches()


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links between components (u, v) within block groups, until they are one."""
    for group in _groups(batches):
        a, b, same, comp = _candidates(group)
        sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        root = {c: c for c in comp.tolist()}

        def find(c: int, root=root) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        us, vs = [], []
        for k in np.argsort(-same, kind="stable").tolist():
            p, q = find(int(comp[a[k]])), find(int(comp[b[k]]))
            if p != q and linked(sets[a[k]], sets[b[k]]):
                root[p] = q
                us.append(int(comp[a[k]]))
                vs.append(int(comp[b[k]]))
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _text_hash(column: Column) -> Column:
    return F.xxhash64(F.coalesce(column, F.lit("")))


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """node, set (sorted 64-bit hashes) of the wanted nodes, from the text of the node's first document.

    A document is found again by its id and its text's hash, so that null ids and ids of several texts meet their own
    text alone.
    """
    need = nodes.join(wanted, "node").select("node", F.col("fp").alias("__fp"), F.col("at.id").alias("__id"), F.col("at.hash").alias("__hash"))
    own = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text"), _text_hash(F.col(text)).alias("__own"))
    source = own.join(need, (F.col("__own") == F.col("__hash")) & F.col("__doc").eqNullSafe(F.col("__id"))).select("node", "__fp", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches):
            sets = shingle_sets(utf8(block.column(2)), hashes, k)
            same = [len(s) > 0 and fingerprint(s) == fp for s, fp in zip(sets, block.column(1).to_pylist(), strict=True)]
            rows = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(rows)), pa.array([sets[r].tobytes() for r in rows], pa.binary())], names=["node", "set"])

    return source.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def members(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs: doc, keep, n_shingles, comp (group; null for empty sets), component_id.

    component_id is the smallest id in the row's group (its own id where it has no
    shingles).  Null ids take part and are passed over by the minimum; repeated rows
    each get a row; ids that several texts share stand for all of them.
    """
    named = docs.withColumn("__hash", _text_hash(F.col(text)))
    rows = cut(sketch_rows(named, text, k, (doc, "__hash", *keep)).withColumnRenamed(doc, "__doc"), "sketches")
    at = F.struct(F.col("__doc").isNull().alias("none"), F.col("__doc").alias("id"), F.col("__hash").alias("hash"))
    full = rows.where("n > 0").groupBy("fp").agg(F.min("__doc").alias("id"), F.min(at).alias("at"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = cut(full.withColumn("node", F.monotonically_increasing_id()), "nodes", small=True)  # ids are fixed by being written
    sketch = nodes.select("node", "n", "regs")
    bands = cut(nodes.select("node", "regs").mapInArrow(_band_rows, "bucket long, node long"), "bands", small=True)
    heads = cut(bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("size")).where("size > 1"), "heads", small=True)  # a table, so that hot buckets' joins can be split
    met = cut(bands.join(heads, "bucket"), "met", small=True)
    drop_cut(bands)

    side = lambda a: sketch.select(F.col("node").alias(a), F.col("n").alias(f"n{a}"), F.col("regs").alias(f"r{a}"))
    pairs = met.where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()
    screened = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "nu", "ru", "v", "nv", "rv")
    screened = cut(screened.mapInArrow(_screen, "u long, v long"), "screened", small=True)
    ends = screened.select(F.col("u").alias("node")).union(screened.select("v")).distinct()
    sets = cut(_sets_of(docs, nodes, ends, doc, text, k), "sets", small=True)
    set_of = lambda a: sets.select(F.col("node").alias(a), F.col("set").alias(f"s{a}"))
    links = screened.join(set_of("u"), "u").join(set_of("v"), "v").select("u", "su", "v", "sv")
    links = cut(links.mapInArrow(_verify, "u long, v long"), "links", small=True)
    comps = components(links)

    # buckets of three nodes or more that still hold several components; pairs with the head have been tried
    # members are dealt by (bucket, chunk) throughout, and what is known of a bucket goes to each of its chunks
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    marked = met.where("size > 2").withColumns({"chunks": chunks, "x": F.pmod(F.xxhash64("node"), chunks).cast("int")})
    marked = marked.join(comps, "node", "left").select("bucket", "x", "chunks", "node", "head", F.coalesce("comp", "node").alias("comp"))
    part = marked.groupBy("bucket", "x", "chunks").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))  # chunks first, then buckets
    split = part.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("chunks").alias("n")).where("lo <> hi")
    split = split.select("bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("x"))
    rest = marked.where("node <> head").join(split, ["bucket", "x"])
    rest = rest.select("bucket", "node", "comp", "x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("y"))
    rest = rest.select("bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "comp", "node")
    keys = ["bucket", "i", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes but much work: not to be coalesced by size
    grouped = rest.join(sketch, "node").select(*keys, "x", "comp", "node", "n", "regs").repartition(parts, *keys).sortWithinPartitions(*keys, "node")
    alive = cut(grouped.mapInArrow(_alive, grouped.schema), "alive", small=True)
    again = alive.join(_sets_of(docs, nodes, alive.select("node").distinct(), doc, text, k), "node")
    again = again.select(*keys, "x", "comp", "node", "n", "regs", "set").repartition(parts, *keys).sortWithinPartitions(*keys, "node")
    late = cut(again.mapInArrow(_join_blocks, "u long, v long"), "links", small=True)
    joined = components(late).select(F.col("node").alias("comp"), F.col("comp").alias("whole"))

    part = nodes.select("node", "fp", "id").join(comps, "node", "left").select("fp", "id", F.coalesce("comp", "node").alias("comp"))
    part = part.join(joined, "comp", "left").select("fp", "id", F.coalesce("whole", "comp").alias("comp"))
    least = part.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_set = cut(part.join(least, "comp").select("fp", "comp", "component_id"), "groups", small=True)
    out = rows.select("__doc", *keep, F.col("n").alias("n_shingles"), "fp").join(by_set, "fp", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("__doc"))
    for t in (nodes, heads, bands, met, screened, sets, links, alive, late):
        drop_cut(t)
    return out.select(F.col("__doc").alias(doc), *keep, "n_shingles", "comp", own.alias("component_id"))


def groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """doc, n_shingles, component_id, kept (whether the row's id is its group's smallest)."""
    found = members(docs, doc, text, k)
    return found.select(doc, "n_shingles", "component_id", F.coalesce(F.col(doc) == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """docs with one row of each group: its smallest id (of equal ids the first by hash of the text).

    Rows without shingles belong to no group and all stay.
    """
    mark = "__mark"
    while mark in docs.columns:  # a column of docs may have any name
        mark += "_"
    rows = docs.withColumn(mark, _text_hash(F.col(text)))
    found = members(rows, doc, text, k, (mark,))
    named = found.where(F.col("comp").isNotNull()).select("comp", F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("id"), F.col(mark).alias("mark")).alias("who"))
    first = named.groupBy("comp").agg(F.min("who").alias("who")).select(F.col("who.id").alias("__id"), F.col("who.mark").alias("__m"))
    same = rows[doc].eqNullSafe(first["__id"]) & (rows[mark] == first["__m"])
    kept = rows.join(first, same, "left_semi").dropDuplicates([doc, mark])
    bare = rows.where(F.coalesce(F.trim(F.regexp_replace(text, "[ \\t-\\r]+", "")), F.lit("")) == "")
    return kept.unionByName(bare).drop(mark)
