"""Patterns on a stream: the first window of each place and motif that holds enough clusters, with state by key and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "place string, motif string, start_ms long, clusters long, domains long, closed boolean"


class FirstWindow(StatefulProcessor):
    """Holds the sightings of a key that may still count, as one list, and the first window so far.

    More sightings move the first window to an earlier start alone, so one behind its end is dropped as it comes. A sighting is dropped, too, once the watermark has passed the end of any window that it could begin; once it has passed
    the first window's end, nothing can change any more, and only that window is kept. So the state of a hot key holds its sightings up to its first window's end; before there is one, those of a window's length and the lateness.
    """

    def __init__(self, hours: int, least: int):
        self.width, self.least = hours * 3_600_000, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "at long, cluster long, domain string")
        self.found = handle.getValueState("found", "start long, clusters long, domains long, closed boolean")

    def _first(self, held: set) -> tuple | None:
        rows = sorted(held, key=lambda r: r[:2])
        end, inside = 0, {}
        for begin, (start, cluster, _) in enumerate(rows):
            while end < len(rows) and rows[end][0] <= start + self.width:
                inside[rows[end][1]] = inside.get(rows[end][1], 0) + 1
                end += 1
            if len(inside) >= self.least:
                return start, len(inside), len({d for _, _, d in rows[begin:end]})
            inside[cluster] -= 1
            if not inside[cluster]:
                del inside[cluster]
        return None

    def _until(self, held: set, now: tuple | None) -> set:
        return held if now is None else {r for r in held if r[0] <= now[0] + self.width}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.found.get() if self.found.exists() else None
        if before is not None and before[3]:
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        stored = set(map(tuple, self.seen.get()))
        now = None if before is None else tuple(before[:3])
        held, tried = set(stored), 2 * len(stored)
        for frame in rows:
            frame = frame if now is None else frame[frame["at"] <= now[0] + self.width]
            held.update(zip(frame["at"].tolist(), frame["cluster"].tolist(), frame["domain"]))
            if len(held) > max(tried, 1024):
                now = self._first(held)
                held = self._until(held, now)
                tried = 2 * len(held)
        now = self._first(held)
        held = self._until(held, now)
        left = {r for r in held if r[0] + self.width >= watermark or (now is not None and r[0] >= now[0])}
        if not left:
            self.seen.clear()
        elif left != stored:
            self.seen.put(sorted(left, key=lambda r: r[:2]))
        if now is not None and (before is None or tuple(before[:3]) != now):
            self.found.update((*now, False))
            self.handle.registerTimer(now[0] + self.width)
            yield pd.DataFrame([(*key, *now, False)], columns=[c.split()[0] for c in RESULT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.found.exists():
            start, clusters, domains, closed = self.found.get()
            if not closed and start + self.width <= timerValues.getCurrentWatermarkInMs():
                self.found.update((start, clusters, domains, True))
                self.seen.clear()
                yield pd.DataFrame([(*key, start, clusters, domains, True)], columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def first_windows(sightings: DataFrame, hours: int = 72, least: int = 3, lateness: str = "30 days") -> DataFrame:
    """(place, motif, start_ms, clusters, domains, closed) of a stream of sightings (place, motif, cluster, domain, ts), in update mode: the last row of each key counts.

    Rows later than ``lateness`` behind the newest time are dropped. All motifs of a place together are one more, ``CONVERGENCE``.
    """
    every = sightings.select("place", F.explode(F.array("motif", F.lit("CONVERGENCE"))).alias("motif"), "cluster", "domain", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return every.withWatermark("ts", lateness).groupBy("place", "motif").transformWithStateInPandas(FirstWindow(hours, least), outputStructType=RESULT, outputMode="Update", timeMode="EventTime")


def run(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs over all that is there. Each batch is written under its number, so that a repeated batch replaces itself; a run that is started again goes on from ``checkpoint``."""
    spark = stream.sparkSession
    former = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    try:
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, former)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last row of each key in what ``run`` wrote."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "closed")).alias("r")).select(*keys, "r.*")
