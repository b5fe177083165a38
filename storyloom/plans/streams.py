"""Queries that run as streams over files that the tables are dealt to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.plans.registry import REPORTS, query
from storyloom.sources.shared import Scratch, shared_folder
from storyloom.sources.tables import read, read_reports
from storyloom.streaming import patterns

FILES = 4


def dealt(df: DataFrame, turn, name: str, files: int = FILES) -> tuple[DataFrame, str]:
    """A stream of ``files`` batches: the rows of each ``turn`` (0 to files - 1), one folder after the other; and a folder of its own.

    A turn is written by as many tasks as run at once, and a batch takes as many files as the turn of most files has.
    """
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    most, known = 1, 0
    for k in range(files):
        df.where(turn == k).coalesce(spark.sparkContext.defaultParallelism).write.mode("append").parquet(f"{base}/in")
        now = len(spark.read.schema(df.schema).parquet(f"{base}/in").inputFiles())
        most, known = max(most, now - known), now
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", most).parquet(f"{base}/in"), base


def sightings(spark, sf_dir) -> DataFrame:
    return read_reports(spark, sf_dir).select(F.col("nation").alias("place"), F.col("part").alias("motif"), "cluster", "domain", F.col("published").cast("timestamp").alias("ts"), "id")


@query(
    "stream_patterns",
    f"WITH {REPORTS}, s AS (SELECT nation AS place, motif, cluster, domain, published AS pub FROM (SELECT *, part AS motif FROM reports UNION ALL SELECT *, 'CONVERGENCE' FROM reports)), "
    "w AS (SELECT a.place, a.motif, a.pub, count(DISTINCT b.cluster) AS n FROM (SELECT DISTINCT place, motif, pub FROM s) a JOIN s b ON a.place = b.place AND a.motif = b.motif AND b.pub BETWEEN a.pub AND a.pub + INTERVAL 72 HOUR GROUP BY 1, 2, 3 HAVING count(DISTINCT b.cluster) >= 3), "
    "f AS (SELECT place, motif, min(pub) AS start_at FROM w GROUP BY 1, 2) SELECT s.place, s.motif, epoch_ms(start_at) AS start_ms, count(DISTINCT cluster) AS clusters, count(DISTINCT domain) AS domains FROM s JOIN f ON s.place = f.place AND s.motif = f.motif AND s.pub BETWEEN start_at AND start_at + INTERVAL 72 HOUR GROUP BY 1, 2, 3",
)
def stream_patterns(spark, sf_dir):
    """First windows of 72 hours by place and motif on a stream of four batches in the order of time, with rows up to a week out of order; windows are closed as the watermark passes."""
    scratch = Scratch(spark)
    rows = scratch.written(sightings(spark, sf_dir).withColumn("day", F.unix_date(F.col("ts").cast("date")) + F.col("id") % 7), "stream-sightings")
    low, high = rows.agg(F.min("day"), F.max("day")).first()
    turn = F.least(F.lit(FILES - 1), F.floor((F.col("day") - F.lit(low)) * FILES / F.lit((high or 1) - (low or 0) + 1)))
    stream, base = dealt(rows, turn, "stream-patterns")
    scratch.close()
    patterns.run(patterns.first_windows(stream), f"{base}/out", f"{base}/state")
    return patterns.latest(spark, f"{base}/out", ["place", "motif"]).drop("closed")


@query(
    "stream_crawl",
    "WITH e AS (SELECT event_id, event_type, user_id, min(ts) OVER (PARTITION BY event_id) AS ts FROM events), k AS (SELECT DISTINCT event_id, event_type, user_id FROM e WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND event_type <> 'click') "
    "SELECT user_id, count(*) AS items, count(DISTINCT event_type) AS kinds FROM k GROUP BY 1",
)
def stream_crawl(spark, sf_dir):
    """Micro-batches of items that come twice, in batches that overlap: too old ones and those of a filtered kind are dropped, ids count once within the watermark, and each batch is merged into a table of counts by key.

    The table is a fold of versions: a batch that is repeated writes its own version again.
    """
    events = read(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    days = F.datediff(F.lit(now).cast("timestamp_ntz"), "ts")
    # each event is in the batch of its time and in the next one
    first = F.greatest(F.lit(0), FILES - 2 - F.floor(days / 8)).cast("int")
    twice = events.withColumn("turn", F.explode(F.array(first, first + 1))).withColumn("ts", F.col("ts").cast("timestamp"))
    stream, base = dealt(twice, F.col("turn"), "stream-crawl")
    fresh = stream.where(F.col("ts") >= F.expr(f"timestamp'{now}' - INTERVAL 10 DAYS")).where("event_type <> 'click'")
    once = fresh.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["event_id"])

    def merge(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
        if number:
            counts = counts.unionByName(batch.sparkSession.read.parquet(f"{base}/out/version={number - 1}"))
        counts.groupBy("user_id", "event_type").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{base}/out/version={number}")

    once.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.parquet(f"{base}/out")
    last = versions.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{base}/out/version={last}").groupBy("user_id").agg(F.sum("n").alias("items"), F.count("*").alias("kinds"))
