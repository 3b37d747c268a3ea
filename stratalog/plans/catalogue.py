"""Registered queries of the key-value engine, and their SQL.

``orders`` is read as a log: the customer is the key, the order number the sequence,
status F is a deletion and any other status sets the total price; runs are blocks of
2500 order numbers.  ``events`` is a log with composite keys.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import compaction, resolve
from ..schema import BASE_BYTES, GROWTH, N_LEVELS
from ..sources.wal import Entry, encode_block, put, read_logs, start_checksum
from ..store import Store
from ..streaming.upsert import upsert_all

RUN_ROWS = 2500


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the whole cluster sees; where none is named, a local one in local mode and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + os.path.join(tempfile.gettempdir(), f"stratalog-{os.getpid()}")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("key"), value.alias("value"), F.col("o_orderkey").alias("seq"))


def run_of() -> Column:
    return F.floor(F.col("seq") / RUN_ROWS).alias("run")


def orders_runs(spark: SparkSession, d: str) -> DataFrame:
    """run, key, value, seq: each run resolved by itself."""
    return resolve.lww(orders_log(spark, d).withColumn("run", run_of()), ["run", "key"])


def kv_live(spark: SparkSession, d: str) -> DataFrame:
    return resolve.live(orders_log(spark, d))


def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    return resolve.multi_get(orders_log(spark, d), spark.range(1, 51).withColumnRenamed("id", "key"))


def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return resolve.get(orders_log(spark, d), 7)


def kv_scan_range(spark: SparkSession, d: str) -> DataFrame:
    return resolve.scan(orders_log(spark, d), 100, 300)


def kv_scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return resolve.scan(orders_log(spark, d), 100, limit=10)


def kv_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return resolve.tombstones(orders_log(spark, d))


def kv_flush_runs(spark: SparkSession, d: str) -> DataFrame:
    return orders_runs(spark, d).select("run", "key", "value")


def kv_minor_order(spark: SparkSession, d: str) -> DataFrame:
    return resolve.lww(orders_runs(spark, d).where("run <= 2"))


def kv_joined(spark: SparkSession, d: str) -> DataFrame:
    runs = orders_runs(spark, d)
    pick = lambda n: runs.where(F.col("run") == n).select("key", "value")
    return resolve.joined(pick(1), pick(0))


def kv_minor_order_all(spark: SparkSession, d: str) -> DataFrame:
    """All runs merged, however many the table has; deletions kept."""
    return resolve.lww(orders_runs(spark, d))


def kv_joined_halves(spark: SparkSession, d: str) -> DataFrame:
    """The newer half of the runs, resolved, over the older half: runs up to half the last run's number are old."""
    runs = orders_runs(spark, d)
    middle = runs.agg(F.floor(F.max("run") / 2).alias("middle"))  # one row
    split = runs.crossJoin(F.broadcast(middle))
    half = lambda where: resolve.lww(split.where(where)).select("key", "value")
    return resolve.joined(half("run > middle"), half("run <= middle"))


def kv_merge_runs(spark: SparkSession, d: str) -> DataFrame:
    merged = orders_runs(spark, d).groupBy("key").agg(F.max_by("value", "run").alias("value"))
    return merged.where("value IS NOT NULL")


def kv_run_stats(spark: SparkSession, d: str) -> DataFrame:
    return resolve.run_stats(orders_runs(spark, d))


def kv_versions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.versions(orders_log(spark, d))


def kv_garbage_versions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.superseded(orders_log(spark, d))


def kv_recover_prefix(spark: SparkSession, d: str) -> DataFrame:
    log = orders_log(spark, d).withColumn("block", run_of())
    blocks = log.select("block").distinct().withColumn("ok", F.col("block") != 3)
    return resolve.recover_prefix(log, blocks)


def kv_recover_last(spark: SparkSession, d: str) -> DataFrame:
    """Live rows of a log whose last block is damaged: all blocks before it are recovered."""
    log = orders_log(spark, d).withColumn("block", run_of())
    last = log.agg(F.max("block").alias("last"))  # one row
    blocks = log.select("block").distinct().crossJoin(F.broadcast(last)).select("block", (F.col("block") != F.col("last")).alias("ok"))
    return resolve.recover_prefix(log, blocks)


def kv_as_of(spark: SparkSession, d: str) -> DataFrame:
    return resolve.as_of(orders_log(spark, d), 7000)


def kv_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    return resolve.range_overlaps(resolve.run_stats(orders_runs(spark, d)))


def kv_largest_pair(spark: SparkSession, d: str) -> DataFrame:
    return resolve.largest_pair(resolve.run_stats(orders_runs(spark, d)))


def kv_level_target(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(N_LEVELS).select(F.col("id").alias("level"), (BASE_BYTES * F.pow(F.lit(GROWTH), "id")).cast("long").alias("target_bytes"))


def kv_be_key(spark: SparkSession, d: str) -> DataFrame:
    return kv_live(spark, d).select("key", F.hex(codecs.be_key("key")).alias("be_key"))


def kv_varint_len(spark: SparkSession, d: str) -> DataFrame:
    return orders_log(spark, d).select("seq", codecs.varint_length("seq").cast("long").alias("n_bytes"))


def kv_prefix_delta(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that each key shares with the one before it in its block of 256 keys, as a block's delta coding starts afresh."""
    keys = kv_live(spark, d).select("key", codecs.be_key("key").alias("k"), F.floor(F.col("key") / 256).alias("block"))
    w = Window.partitionBy("block").orderBy("key")
    common = F.when(F.lag("k").over(w).isNull(), 0).otherwise(codecs.common_prefix(F.col("k"), F.lag("k").over(w)))
    return keys.select("key", common.cast("long").alias("n_common"))


def _series(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", value.alias("value"), F.col("event_id").alias("seq"))


def kv_series_scan(spark: SparkSession, d: str) -> DataFrame:
    """Live events of one series, by the prefix of a composite key."""
    log = _series(spark, d).where("user_id = 8")
    return resolve.live(log, ["user_id", "event_id"]).orderBy("user_id", "event_id")


def kv_crc32(spark: SparkSession, d: str) -> DataFrame:
    return kv_live(spark, d).select("key", F.crc32(codecs.be_key("key")).alias("crc"))


def kv_crc32_chain(spark: SparkSession, d: str) -> DataFrame:
    return kv_live(spark, d).select("key", codecs.crc32_udf(codecs.be_key("key"), F.lit(1337)).alias("crc"))


def kv_murmur3(spark: SparkSession, d: str) -> DataFrame:
    return kv_live(spark, d).select("key", codecs.murmur3_udf(codecs.be_key("key"), F.lit(0)).alias("hash"))


def kv_varint(spark: SparkSession, d: str) -> DataFrame:
    return kv_live(spark, d).select("key", F.hex(codecs.varint_udf("key")).alias("varint"))


def kv_encode_pair(spark: SparkSession, d: str) -> DataFrame:
    newest = resolve.lww(orders_log(spark, d))
    value = F.when(F.col("value").isNotNull(), codecs.be_key(F.round(F.col("value") * 100).cast("long")))
    return newest.select("key", F.hex(codecs.pair_udf(codecs.be_key("key"), value)).alias("pair"))


def kv_wal_block(spark: SparkSession, d: str) -> DataFrame:
    """The whole log in the log format, one block for each key, encoded where the rows are; its size and checksum.

    Each key's block starts a chain of its own, so that blocks are independent.
    """
    rows = orders_log(spark, d).select("key", "seq", codecs.be_key("key").alias("k"), F.when(F.col("value").isNotNull(), codecs.be_key(F.round(F.col("value") * 100).cast("long"))).alias("v"))

    def encode(batches):
        import pandas as pd

        for b in batches:
            out = [encode_block([put(bytes(k), None if v is None else bytes(v))], start_checksum()) for k, v in zip(b["k"], b["v"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "seq": b["seq"], "n_bytes": [len(x) for x, _ in out], "checksum": [c for _, c in out]})

    return rows.mapInPandas(encode, "key long, seq long, n_bytes long, checksum long")


def kv_wal_read(spark: SparkSession, d: str) -> DataFrame:
    """The writes of two small logs, read back; the second ends in a damaged block."""
    from ..sources.blobs import Blobs
    from ..sources.wal import HEADER

    folder = _scratch(spark, "logs")
    files = Blobs(spark, folder)
    a, c = encode_block([put(b"a", b"1"), put(b"b", b"")], start_checksum())
    b, _ = encode_block([put(b"a", None), Entry(2, ("wal.0.log",), "r1")], c)
    files.create("wal.0.log", HEADER + a + b)
    files.create("wal.1.log", HEADER + a + b[:-1] + b"?")
    return read_logs(spark, folder).select("log", "block", "entry", "tag", F.hex("key").alias("key"), F.hex("value").alias("value"), "run")


def kv_store(spark: SparkSession, d: str) -> DataFrame:
    """The orders log written to a store run by run, compacted and read back in key order."""
    log = orders_log(spark, d)
    value = F.when(F.col("value").isNotNull(), codecs.be_key(F.round(F.col("value") * 100).cast("long")))
    rows = log.select(codecs.be_key("key").alias("key"), value.alias("value"), "seq")
    store = Store.create(spark, _scratch(spark, "store"))
    middle = log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    store.put_df(rows.where(F.col("seq") <= middle), order="seq")
    store.put_df(rows.where(F.col("seq") > middle), order="seq")
    store.compact()
    out = store.scan().df().select(F.hex("key").alias("key"), F.hex("value").alias("value"))
    store.close()
    return out


def kv_regular_order(spark: SparkSession, d: str) -> DataFrame:
    """The largest neighbouring pair of runs merged into the next level, deletions kept as older runs may lie below."""
    runs = orders_runs(spark, d)
    pair = resolve.largest_pair(resolve.run_stats(runs))  # one row
    two = pair.select(F.explode(F.array("run", "next_run")).alias("run"))
    picked = runs.join(F.broadcast(two), "run", "left_semi").select("key", "value", "seq")
    return compaction.merge(picked, bottom=False)


def kv_runs_with_key(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose key range holds a key: what a point read has to open."""
    return resolve.run_stats(orders_runs(spark, d)).where("min_key <= 2 AND max_key >= 2").select("run", "min_key", "max_key")


def kv_run_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many runs of each kind a store has after two bulk writes, a compaction and another write."""
    store = Store.create(spark, _scratch(spark, "store"))
    rows = orders_log(spark, d).select(codecs.be_key("key").alias("key"), F.unhex(F.lit("01")).alias("value"))
    for _ in range(2):
        store.put_df(rows)
    store.compact()
    store.put_df(rows.limit(10))
    return store.runs().groupBy("kind").agg((F.count("*") > 0).alias("found"))


def kv_bloom(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a Bloom filter over the live keys, built where the keys are."""
    bits = 8 * 2048
    hashed = kv_live(spark, d).select(codecs.murmur3_udf(codecs.be_key("key"), F.lit(0)).alias("h")).select((F.col("h") % bits).alias("b"))
    return hashed.groupBy(F.floor(F.col("b") / 8).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, cast(b % 8 AS int))")).alias("bits"))


def kv_fsck(spark: SparkSession, d: str) -> DataFrame:
    """Files of a store that its manifest does not know: what a compaction has replaced."""
    store = Store.create(spark, _scratch(spark, "store"))
    store.put_df(orders_log(spark, d).select(codecs.be_key("key").alias("key"), F.unhex(F.lit("01")).alias("value")))
    store.compact()
    return store.fsck().groupBy("problem").agg((F.count("*") > 0).alias("found"))


def kv_stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    files = f"{d}/orders.parquet"
    plain = spark.read.parquet(files).schema
    reader = spark.readStream.schema(plain)
    # a table may be one file or a folder of files; a file source watches a folder
    stream = reader.option("pathGlobFilter", "*.parquet").parquet(files) if _is_folder(spark, files) else reader.option("pathGlobFilter", "orders.parquet").parquet(d)
    value = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    rows = stream.select(F.col("o_custkey").alias("key"), value.alias("value"), F.col("o_orderkey").alias("seq"))
    return upsert_all(spark, rows, _scratch(spark, "stream"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kv_live, kv_get, kv_multi_get, kv_scan_range, kv_scan_limit, kv_tombstones, kv_flush_runs, kv_minor_order, kv_joined,
        kv_merge_runs, kv_run_stats, kv_versions, kv_garbage_versions, kv_recover_prefix, kv_as_of, kv_range_overlap,
        kv_largest_pair, kv_level_target, kv_be_key, kv_varint_len, kv_prefix_delta, kv_series_scan, kv_crc32, kv_crc32_chain,
        kv_murmur3, kv_varint, kv_encode_pair, kv_wal_block, kv_wal_read, kv_store, kv_fsck, kv_regular_order, kv_runs_with_key, kv_run_kinds, kv_bloom, kv_stream_upsert,
        kv_minor_order_all, kv_joined_halves, kv_recover_last,
    )
}

_PRELUDE = f"""
WITH l AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value,
                  o_orderkey // {RUN_ROWS} AS run FROM orders),
w AS (SELECT key, value, seq FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
r AS (SELECT run, key, value, seq FROM l QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1),
s AS (SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS n_pairs,
             count(*) FILTER (value IS NULL) AS n_tombstones, max(seq) AS max_seq FROM r GROUP BY run)
"""
_LIVE = "SELECT key, value FROM w WHERE value IS NOT NULL"
_HEX = "lpad(upper(to_hex({})), 16, '0')"

ORACLE: dict[str, str] = {
    name: _PRELUDE + sql
    for name, sql in {
        "kv_live": _LIVE,
        "kv_get": _LIVE + " AND key = 7",
        "kv_multi_get": _LIVE + " AND key BETWEEN 1 AND 50",
        "kv_scan_range": _LIVE + " AND key >= 100 AND key < 300 ORDER BY key",
        "kv_scan_limit": _LIVE + " AND key >= 100 ORDER BY key LIMIT 10",
        "kv_tombstones": "SELECT key, seq FROM w WHERE value IS NULL",
        "kv_flush_runs": "SELECT run, key, value FROM r",
        "kv_minor_order": "SELECT key, value, seq FROM r WHERE run <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1",
        "kv_joined": """SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN a.value ELSE b.value END AS value
            FROM (SELECT * FROM r WHERE run = 1) a FULL JOIN (SELECT * FROM r WHERE run = 0) b ON a.key = b.key""",
        "kv_merge_runs": _LIVE,
        "kv_run_stats": "SELECT * FROM s",
        "kv_versions": "SELECT key, count(*) AS n_versions, count(value) AS n_values FROM l GROUP BY key",
        "kv_garbage_versions": "SELECT l.key, l.value, l.seq FROM l JOIN w ON w.key = l.key WHERE l.seq < w.seq",
        "kv_recover_prefix": """SELECT key, value FROM (SELECT * FROM l WHERE run < 3 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
            WHERE value IS NOT NULL""",
        "kv_as_of": """SELECT key, value FROM (SELECT * FROM l WHERE seq <= 7000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
            WHERE value IS NOT NULL""",
        "kv_range_overlap": "SELECT a.run AS run_a, b.run AS run_b FROM s a JOIN s b ON a.run < b.run AND a.min_key <= b.max_key AND a.max_key >= b.min_key",
        "kv_largest_pair": """SELECT run, next_run, size FROM (SELECT run, lead(run) OVER (ORDER BY run) AS next_run,
            n_pairs + lead(n_pairs) OVER (ORDER BY run) AS size FROM s) WHERE next_run IS NOT NULL ORDER BY size DESC, run LIMIT 1""",
        "kv_level_target": f"SELECT range AS level, ({BASE_BYTES} * pow({GROWTH}, range))::BIGINT AS target_bytes FROM range({N_LEVELS})",
        "kv_be_key": f"SELECT key, {_HEX.format('key')} AS be_key FROM w WHERE value IS NOT NULL",
        "kv_varint_len": "SELECT seq, CASE WHEN seq < 128 THEN 1 WHEN seq < 16384 THEN 2 WHEN seq < 2097152 THEN 3 ELSE 4 END::BIGINT AS n_bytes FROM l",
        "kv_prefix_delta": """SELECT key, CASE WHEN p IS NULL THEN 0 WHEN xor(key, p) < 256 THEN 7 WHEN xor(key, p) < 65536 THEN 6 WHEN xor(key, p) < 16777216 THEN 5
            ELSE 4 END::BIGINT AS n_common FROM (SELECT key, lag(key) OVER (PARTITION BY key // 256 ORDER BY key) AS p FROM w WHERE value IS NOT NULL)""",
        "kv_series_scan": "SELECT user_id, event_id, value FROM events WHERE user_id = 8 AND event_type <> 'error' AND value IS NOT NULL ORDER BY event_id",
        "kv_encode_pair": f"""SELECT key, '08' || {_HEX.format('key')} || CASE WHEN value IS NULL THEN '00'
            ELSE 'FF08' || {_HEX.format('round(value * 100)::BIGINT')} END AS pair FROM w""",
        "kv_varint": """SELECT key, CASE WHEN key < 128 THEN lpad(upper(to_hex(key)), 2, '0')
            WHEN key < 16384 THEN lpad(upper(to_hex(key & 127 | 128)), 2, '0') || lpad(upper(to_hex(key >> 7)), 2, '0')
            ELSE lpad(upper(to_hex(key & 127 | 128)), 2, '0') || lpad(upper(to_hex(key >> 7 & 127 | 128)), 2, '0') || lpad(upper(to_hex(key >> 14)), 2, '0') END AS varint
            FROM w WHERE value IS NOT NULL""",
        "kv_store": f"SELECT {_HEX.format('key')} AS key, {_HEX.format('round(value * 100)::BIGINT')} AS value FROM w WHERE value IS NOT NULL",
        "kv_stream_upsert": _LIVE,
        "kv_regular_order": """SELECT key, value, seq FROM l WHERE run IN (SELECT unnest([run, next_run]) FROM (
            SELECT run, next_run FROM (SELECT run, lead(run) OVER (ORDER BY run) AS next_run, n_pairs + lead(n_pairs) OVER (ORDER BY run) AS size FROM s)
            WHERE next_run IS NOT NULL ORDER BY size DESC, run LIMIT 1)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""",
        "kv_minor_order_all": "SELECT key, value, seq FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1",
        "kv_joined_halves": """SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NOT NULL THEN a.value ELSE b.value END AS value
            FROM (SELECT * FROM l WHERE run > (SELECT max(run) // 2 FROM l) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) a
            FULL JOIN (SELECT * FROM l WHERE run <= (SELECT max(run) // 2 FROM l) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) b ON a.key = b.key""",
        "kv_recover_last": """SELECT key, value FROM (SELECT * FROM l WHERE run < (SELECT max(run) FROM l) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
            WHERE value IS NOT NULL""",
        "kv_runs_with_key": "SELECT run, min_key, max_key FROM s WHERE 2 BETWEEN min_key AND max_key",
    }.items()
}
ORACLE["kv_run_kinds"] = "SELECT unnest(['base', 'minor']) AS kind, true AS found"
ORACLE["kv_fsck"] = "SELECT 'untracked' AS problem, true AS found"
