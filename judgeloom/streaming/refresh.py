"""Continuous refresh of a corpus: each micro-batch of new rows is merged into a stored table, partition by partition.

A batch is the version of its number, so one that runs again after a failure changes nothing; it rewrites the buckets its own keys are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import BUCKETS, Store


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest whole version (below before, if given)."""
    store = Store(spark, folder, [], "")
    known = [v for v in store.versions() if before is None or v < before]
    return store.read(known[-1]) if known else None


def run(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge a stream of rows into the table at folder, new rows winning; stops when the available input is used."""

    def merge(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, folder, keys, order, buckets).upsert(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
