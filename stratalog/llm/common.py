"""Helpers shared by the corpus operators: shared-folder tables, Arrow blocks, words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch from the JVM, unless BLOCK_BYTES are reached before; operators join batches up to BLOCK_BYTES.
BATCH_ROWS = 512
#: Text bytes that one block holds, unless a single row is larger.  Words and hashes of a block take some 30 times as
#: much, in each of an executor's Python workers.
BLOCK_BYTES = 4 << 20
#: Distinct words a Python worker remembers before it starts afresh.
CACHE_WORDS = 250_000
#: What an executor's JVM holds of texts at once: rows of a reader's batch, bytes of a row group that is written; and no
#: reads into buffers outside the heap, which take each column of a row group twice more and are kept by their threads.
READ_ROWS, GROUP_BYTES = 64, 16 << 20
TASKS_PER_CORE = 8
#: Bytes that may be broadcast at once; larger inputs go in blocks of this size.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir; where none is set, a local one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"stratalog-{os.getpid()}")
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go as soon as its rows are in place, not at some later garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def cut(df: DataFrame, name: str = "t", small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files every executor sees.

    small: the rows are few for the tasks that make them (identifiers, links), so that
    TASKS_PER_CORE tasks for each core of the cluster write them, and not one for each
    shuffle partition.
    """
    if small:
        df = df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    path = f"{shared_dir(df.sparkSession)}/stratalog-{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stratalog_path = path  # type: ignore[attr-defined]
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that no later step reads."""
    spark, path = df.sparkSession, getattr(df, "_stratalog_path", None)
    if path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bound rows and bytes of what is read, sent to Python and written at once, so that long texts cannot fill an executor."""
    wanted = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BLOCK_BYTES,
        "spark.sql.parquet.columnarReaderBatchSize": READ_ROWS,
        "parquet.block.size": GROUP_BYTES,
        "parquet.hadoop.vectored.io.enabled": "false",
    }
    for what in ("page", "block"):  # the writer looks at its bytes after so many rows
        wanted |= {f"parquet.{what}.size.row.check.min": 4, f"parquet.{what}.size.row.check.max": BATCH_ROWS}
    for key, value in wanted.items():
        if spark.conf.get(key, None) != str(value):
            spark.conf.set(key, str(value))


def blocks(batches: Iterable[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Join consecutive batches into blocks of about limit bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def others(keep: Iterable[str], made: Iterable[str]) -> tuple[str, ...]:
    """Columns of keep that an operator passes on: one with the name of a result gives way to the result."""
    return tuple(c for c in keep if c not in set(made))


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and blanks every ASCII byte outside 0-9 and a-z.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def join_texts(texts: list[bytes], table: bytes = LOWER) -> tuple[bytes, np.ndarray]:
    """All texts in one byte string, each ended by a newline, and each one's first offset."""
    joined = b"\n".join([*texts, b""])
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=starts[1:])
    return (joined.translate(table) if table else joined), starts


def split_words(texts: list[bytes], table: bytes = LOWER) -> tuple[list[bytes], np.ndarray]:
    """Words of all texts in order, and how many each text has.

    With LOWER a word is a run of bytes other than ASCII white space; with ALNUM
    ASCII punctuation and controls part words too.
    """
    joined, starts = join_texts(texts, table)
    space = _IS_SPACE[np.frombuffer(joined, np.uint8)]
    first = ~space
    first[1:] &= space[:-1]
    return joined.split(), per_text(first, starts)


def per_text(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of mask over each text's bytes (its closing newline included)."""
    if len(starts) == 1:
        return np.zeros(0, np.int64)
    return np.add.reduceat(mask, starts[:-1], dtype=np.int64)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to CACHE_WORDS distinct words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive items; len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out)


def id_text(column: str | Column) -> Column:
    """An id as text for crc32 folds; null reads as the empty text."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))


def fold_of(column: str, n: int) -> Column:
    """crc32 of the id's text modulo n."""
    return F.crc32(id_text(column).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
