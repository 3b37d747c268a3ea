"""A key-value store: a folder of sorted Parquet runs, logs of single writes, and a manifest."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Manifest, Version
from .operators import compaction, resolve
from .operators.compaction import Order, Run
from .schema import LOG, MINOR, RUN
from .sources.blobs import Blobs
from .sources.wal import NAME, REMOVE, SET, LogWriter, put, read_logs


@dataclass(frozen=True)
class StoreOptions:
    """max_concurrent_writers: tasks that write a run (0: as many as the data asks for);
    max_wal_bytes: log bytes after which single writes are flushed to a run;
    cache_size_bytes: above 0, recovered runs are cached by Spark, which evicts by its own memory settings."""

    max_concurrent_writers: int = 0
    max_wal_bytes: int = 64 << 20
    cache_size_bytes: int = 0

    def with_max_concurrent_writers(self, n: int) -> StoreOptions:
        return replace(self, max_concurrent_writers=n)

    def with_max_wal_bytes(self, n: int) -> StoreOptions:
        return replace(self, max_wal_bytes=n)

    def with_cache_size_bytes(self, n: int) -> StoreOptions:
        return replace(self, cache_size_bytes=n)


class Scanner:
    """Live pairs in key order; from_() is inclusive, to() exclusive.  A snapshot as of its creation."""

    def __init__(self, store: Store, version: Version, buffered: dict[bytes, bytes | None], lo: bytes | None = None, hi: bytes | None = None) -> None:
        self._store, self._version, self._buffered, self._lo, self._hi = store, version, buffered, lo, hi

    def from_(self, key: bytes) -> Scanner:
        return Scanner(self._store, self._version, self._buffered, key, self._hi)

    def to(self, key: bytes) -> Scanner:
        return Scanner(self._store, self._version, self._buffered, self._lo, key)

    def df(self, limit: int | None = None) -> DataFrame:
        """key and value, ordered."""
        return resolve.scan(self._store._log(self._version, self._buffered, self._lo, self._hi), self._lo, self._hi, limit)

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for row in self.df().toLocalIterator(prefetchPartitions=True):
            yield bytes(row.key), bytes(row.value)


class Store:
    """Use create() or recover().  One writer at a time: a second one's commit fails."""

    def __init__(self, spark: SparkSession, path: str, options: StoreOptions, version: Version) -> None:
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self._manifest = Manifest(Blobs(spark, f"{self.path}/manifest"))
        self._logs = Blobs(spark, f"{self.path}/wal")
        self._runs = Blobs(spark, f"{self.path}/runs")
        self._version = version
        self._buffer: dict[bytes, bytes | None] = {}
        self._lock = threading.RLock()
        self._pool = ThreadPoolExecutor(max_workers=4)
        self._writer: LogWriter | None = None
        self._closed = False

    # opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, options: StoreOptions = StoreOptions()) -> Store:
        """A new store; FileExistsError where there is one."""
        first = Version()
        store = cls(spark, path, options, first)
        if store._manifest.versions():
            raise FileExistsError(path)
        store._manifest.commit(first)
        return store

    @classmethod
    def recover(cls, spark: SparkSession, path: str, options: StoreOptions = StoreOptions()) -> Store:
        """Open a store: writes in the intact blocks of its logs become a run, then the logs go."""
        store = cls(spark, path, options, Version())
        found = store._manifest.load()
        if found is None:
            raise FileNotFoundError(path)
        store._version = found
        names = [n for n in store._logs.names() if NAME.fullmatch(n)]
        if names:
            rows = read_logs(spark, f"{store.path}/wal").where(F.col("tag").isin(SET, REMOVE))
            order = F.struct("log", "block", "entry")
            last = rows.groupBy("key").agg(F.max_by("value", order).alias("value"))
            top = max(int(NAME.fullmatch(n)[1]) for n in names) + 1
            store._version.next_log = max(store._version.next_log, top)
            store._add(last, "recover")
            for n in names:
                store._logs.delete(n)
        return store

    # single writes

    def set(self, key: bytes, value: bytes) -> None:
        self._write(bytes(key), bytes(value))

    def remove(self, key: bytes) -> None:
        """Delete a key, whether it exists or not."""
        self._write(bytes(key), None)

    def _write(self, key: bytes, value: bytes | None) -> None:
        with self._lock:
            self._check()
            if self._writer is None:
                self._writer = LogWriter(self.spark, f"{self.path}/wal/wal.{self._version.next_log}.log")
                self._version.next_log += 1
            n = self._writer.write([put(key, value)])
            self._buffer[key] = value
            if n >= self.options.max_wal_bytes:
                self.flush()

    def async_set(self, key: bytes, value: bytes) -> Future:
        return self._pool.submit(self.set, key, value)

    def async_remove(self, key: bytes) -> Future:
        return self._pool.submit(self.remove, key)

    # bulk writes

    def put_df(self, df: DataFrame, order: str | None = None) -> None:
        """Write rows (key binary, value binary or null for deletions) as one run.

        Of rows with the same key the one with the largest order wins; without an order
        a repeated key's winner is its largest value, deletions last.
        """
        with self._lock:
            self._check()
            self.flush()
            by = F.col(order) if order else F.struct(F.col("value").isNotNull(), F.col("value"))
            self._add(df.groupBy("key").agg(F.max_by("value", by).alias("value")), "put")

    def _buffered(self, rows: dict[bytes, bytes | None]) -> DataFrame:
        pairs = [(bytearray(k), None if v is None else bytearray(v), self._version.next_seq) for k, v in rows.items()]
        return self.spark.createDataFrame(pairs, LOG)

    def flush(self) -> None:
        """Move single writes into a run; nothing to do is no error."""
        with self._lock:
            self._check()
            if self._buffer:
                self._add(self._buffered(self._buffer).select("key", "value"), "flush")
                self._buffer = {}
            if self._writer is not None:
                self._writer.close()
                self._writer = None
                for n in self._logs.names():
                    if NAME.fullmatch(n):
                        self._logs.delete(n)

    def _add(self, rows: DataFrame, event: str) -> None:
        """A batch with one row a key becomes minor runs of the next sequence number."""
        seq = self._version.next_seq
        self._install(event, [], rows.withColumn("seq", F.lit(seq).cast("long")), MINOR, seq + 1)

    def _install(self, event: str, old: list[Run], rows: DataFrame, level: int, next_seq: int) -> None:
        """Write rows as sorted files, one run each, and commit them in the place of old ones."""
        old_ids = {r.run_id for r in old}
        made = self._write_runs(rows, level, self._version.next_run, sum(r.n_bytes for r in old))
        kept = [r for r in self._version.runs if r.run_id not in old_ids]
        v = replace(
            self._version,
            version=self._version.version + 1,
            event=event,
            in_runs=sorted(old_ids),
            out_runs=[r.run_id for r in made],
            next_run=self._version.next_run + len(made),
            next_seq=next_seq,
            runs=kept + made,
        )
        self._manifest.commit(v)
        self._version = v

    def _write_runs(self, rows: DataFrame, level: int, first: int, size: int) -> list[Run]:
        folder = f"{self.path}/runs/{uuid.uuid4().hex}"
        n = self.options.max_concurrent_writers or max(1, -(-size // compaction.level_bytes(max(0, level)))) if level >= 0 else self.options.max_concurrent_writers
        # ranges of keys: each file is a sorted run of its own
        ranged = rows.repartitionByRange(n, "key") if n else rows.repartitionByRange("key")
        writer = ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "1000000")
        writer.parquet(folder)
        data = self.spark.read.schema(LOG).parquet(folder)
        size_of = F.length("key") + F.coalesce(F.length("value"), F.lit(0))
        stats = data.groupBy(F.input_file_name().alias("path")).agg(
            F.hex(F.min("key")).alias("lo"), F.hex(F.max("key")).alias("hi"), F.count("*").alias("n"), F.sum(size_of).alias("b"),
            F.max(F.col("value").isNull()).alias("t"), F.min("seq").alias("s0"), F.max("seq").alias("s1"),
        )
        kind = "base" if level == 7 else "minor" if level < 0 else "level"
        found = sorted(stats.collect(), key=lambda r: r.lo)  # a row for each file
        return [Run(first + i, kind, level, r.lo, r.hi, r.n, r.b, r.t, r.s0, r.s1, r.path) for i, r in enumerate(found)]

    # reading

    def _log(self, version: Version, buffered: dict[bytes, bytes | None], lo: bytes | None = None, hi: bytes | None = None, key: bytes | None = None) -> DataFrame:
        """All versions of keys that may lie in a range: runs that cannot hold them are left out by their bounds."""
        a = (key if key is not None else lo).hex().upper() if (key is not None or lo is not None) else None
        b = key.hex().upper() if key is not None else hi.hex().upper() if hi is not None else None
        paths = [r.path for r in version.runs if (a is None or r.max_key >= a) and (b is None or r.min_key <= b)]
        out = self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)
        if self.options.cache_size_bytes and paths:
            out = out.cache()
        rows = {k: v for k, v in buffered.items() if (key is None or k == key)}
        return out.unionByName(self._buffered(rows)) if rows else out

    def log(self) -> DataFrame:
        """Every stored version: key, value (null: deletion), seq."""
        return self._log(self._version, dict(self._buffer))

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def get(self, key: bytes) -> bytes | None:
        with self._lock:
            self._check()
            if key in self._buffer:
                return self._buffer[key]
            log = self._log(self._version, {}, key=key)
        row = resolve.get(log, bytearray(key)).first()
        return None if row is None else bytes(row.value)

    def async_get(self, key: bytes) -> Future:
        return self._pool.submit(self.get, key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return resolve.multi_get(self.log(), keys)

    def scan(self) -> Scanner:
        with self._lock:
            self._check()
            return Scanner(self, self._version, dict(self._buffer))

    async_scan = scan

    def register_views(self, prefix: str = "kv") -> None:
        """Temp views <prefix>_live, <prefix>_log and <prefix>_runs for SQL."""
        self.live().createOrReplaceTempView(f"{prefix}_live")
        self.log().createOrReplaceTempView(f"{prefix}_log")
        self.runs().createOrReplaceTempView(f"{prefix}_runs")

    def runs(self) -> DataFrame:
        rows = [tuple(getattr(r, f.name) for f in RUN) for r in self._version.runs]
        return self.spark.createDataFrame(rows, RUN)

    # maintenance

    def compact(self) -> None:
        """Flush, then merge everything into the bottom level without deletions."""
        with self._lock:
            self.flush()
            self._run(compaction.major_order(self._version.runs))

    def maintain(self) -> str | None:
        """Do the most urgent compaction; its event, or None."""
        with self._lock:
            self._check()
            order = compaction.most_urgent(self._version.runs)
            self._run(order)
            return order.event if order else None

    def _run(self, order: Order | None) -> None:
        if order is None:
            return
        rows = self.spark.read.schema(LOG).parquet(*(r.path for r in order.runs))
        self._install(order.event, list(order.runs), compaction.merge(rows, order.bottom), order.level, self._version.next_seq)

    def fsck(self) -> DataFrame:
        """Files that disagree with the manifest: path and problem (untracked or missing)."""
        known = self.spark.createDataFrame([(r.path,) for r in self._version.runs], "path string")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.path}/runs").select("path")
        same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
        known, files = known.select(same("path").alias("path")), files.select(same("path").alias("path"))
        untracked = files.join(known, "path", "left_anti").withColumn("problem", F.lit("untracked"))
        return untracked.union(known.join(files, "path", "left_anti").withColumn("problem", F.lit("missing")))

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest versions and delete folders that none of them uses; the number deleted."""
        with self._lock:
            self._manifest.expire(keep)
            used = {r.path.rsplit("/", 2)[-2] for v in self._manifest.versions() for r in self._manifest.load(v).runs}
            gone = [n for n in self._runs.names() if n not in used]
            for n in gone:
                self._runs.delete(n)
            return len(gone)

    def close(self) -> None:
        """Sync the log; later calls fail.  Single writes stay in the log until recover()."""
        with self._lock:
            if not self._closed:
                if self._writer is not None:
                    self._writer.close()
                self._pool.shutdown(wait=False)
                self._closed = True

    def _check(self) -> None:
        if self._closed:
            raise ValueError("the store is closed")
