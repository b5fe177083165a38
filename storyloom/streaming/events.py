"""Structured Streaming forms of the event operators. Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """The events in the files of ``folder``; with ``name``, those of the file or folder of that name in it."""
    stream = spark.readStream.schema(SCHEMA)
    if name is None:
        return stream.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{name}")
    return stream.option("pathGlobFilter", name).parquet(folder)


def deduplicated(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """The first of rows that repeat an id within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def circuit_breaker(events: DataFrame, limit: int = 5) -> DataFrame:
    """For each user the failures in a row so far, and whether they have reached ``limit``. State: one number for each key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = state.get[0] if state.exists else 0
        for event_type in pd.concat(batches).sort_values(["ts", "event_id"])["event_type"]:
            row = row + 1 if event_type == "error" else 0
        state.update((row,))
        yield pd.DataFrame([(key[0], row, row >= limit)], columns=["user_id", "failures", "is_open"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, failures long, is_open boolean", "failures long", "update", GroupStateTimeout.NoTimeout
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs over all that is there, writing each batch under its id, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
