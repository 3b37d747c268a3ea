"""Upserts from a stream: newest version of each key by seq (into_store(): by batch, then by seq)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import live
from ..store import Store


def resolved(stream: DataFrame, keys: str = "key") -> DataFrame:
    """The newest version of each key so far; run it in update or complete mode.  Late rows lose by seq, so no watermark is needed."""
    return stream.groupBy(keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def into_store(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch (key binary, value binary, seq) into a store as one run.

    Within a batch seq decides; across batches the later batch wins, as a store numbers its writes itself.  So a late
    row with a smaller seq does overwrite a newer one, and a repeated batch overwrites what came after it: use
    upsert_all() where rows may come late.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.put_df(batch, order="seq")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_all(spark: SparkSession, stream: DataFrame, folder: str, keys: str = "key") -> DataFrame:
    """Run a stream (keys, value, seq) to its end and return its live rows.

    Every micro-batch is resolved and appended to folder; reading resolves across
    batches, so replayed batches and late rows are harmless.
    """
    out = f"{folder}/{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        resolved(batch, keys).write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return live(spark.read.parquet(f"{out}/rows").drop("batch"), keys)
