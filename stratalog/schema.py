"""Schemas of the log, its runs and mutations."""

from pyspark.sql import types as T

#: One version of a key; a null value is a deletion, an empty one is a value.
LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)
#: A sorted run as the manifest knows it; keys in hex, so that text order is key order.
RUN = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
        T.StructField("n_pairs", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("has_tombstones", T.BooleanType()),
        T.StructField("min_seq", T.LongType()),
        T.StructField("max_seq", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)
#: Levels of merged runs; new runs that are not merged yet stand above level 0.
N_LEVELS = 8
MINOR = -1
BASE_BYTES = 8 << 20
GROWTH = 4
