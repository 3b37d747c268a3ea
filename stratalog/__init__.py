"""Ordered key-value data on Spark: an append-only log, newest version wins, sorted Parquet runs."""

from .store import Store, StoreOptions

__all__ = ["Store", "StoreOptions"]
