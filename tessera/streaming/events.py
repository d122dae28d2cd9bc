"""Windowed aggregates over event streams, and incremental upserts as micro-batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sync import commit_version, merge_version

#: Setting of the class that keeps a stream's state.
STATE = "spark.sql.streaming.stateStore.providerClass"
#: Keeps it on the executors' disks; Spark's default keeps all of it in their heaps.
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed(stream: DataFrame, ts: str, width: str, keys: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum per window (tumbling, or sliding by ``slide``) and keys; events later than ``late`` are left out."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Runs of events of a key with no gap above ``gap``."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = stream.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def complete_stream(stream: DataFrame, folder: str, checkpoint: str, state: str | None = None):
    """Run an aggregation over what is there, then stop; its result is the last version of the table at ``folder``.

    Each micro-batch writes the whole result so far as a version of its own, from the executors: no row of it reaches the
    driver. A batch that is replayed after a failure writes the same rows again. ``state`` is this stream's ``STATE``
    (``ON_DISK`` if it has a row for many keys); without it the session's holds.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STATE)

    def put(batch: DataFrame, number: int) -> None:
        commit_version(batch, folder)

    conf.set(STATE, state or before)  # the stream takes a copy of the session's settings as it starts
    try:
        return stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STATE, before)


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: str, checkpoint: str):
    """Upsert each micro-batch into the versioned table at ``folder``; reads what is there, then stops.

    Each batch is merged under a tag of its own, so that one that is replayed after a failure is not merged again,
    and rewrites only the parts of the table that its keys fall into.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def merge(batch: DataFrame, number: int) -> None:
        merge_version(batch, folder, keys, order, tag=f"{name}b{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
