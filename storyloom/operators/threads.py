"""Threads: sequences, gaps, co-occurrence windows and the fold that assigns stories to threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sequenced(events: DataFrame, thread: str, branch: str, ts: str, tie: str) -> DataFrame:
    """Adds the number of each event in its branch, and its code ``branch.number``."""
    at = F.row_number().over(Window.partitionBy(thread, branch).orderBy(ts, tie))
    return events.withColumn("sequence_index", at).withColumn("sequence_code", F.concat_ws(".", F.col(branch), at.cast("string")))


def reactivations(events: DataFrame, thread: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """For each thread: events, first and last time, and how often it came back after more than ``seconds`` of silence, counted between whole seconds."""
    before = F.lag(ts).over(Window.partitionBy(thread).orderBy(ts, tie))
    gap = F.expr(f"timestampdiff(SECOND, date_trunc('SECOND', _before), date_trunc('SECOND', {ts}))")
    return (
        events.withColumn("_before", before)
        .withColumn("_back", F.coalesce(gap > seconds, F.lit(False)).cast("int"))
        .groupBy(thread)
        .agg(F.count("*").alias("events"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.sum("_back").alias("reactivations"))
    )


def dense_windows(events: DataFrame, key: str, ts: str, member: str, hours: int, least: int) -> DataFrame:
    """For each key, the first time from which ``hours`` hold ``least`` or more different members, and how many they hold.

    A member counts from ``hours`` before each of its events up to that event, or up to the next event's start if that comes earlier,
    so that the number of members is a running sum of starts and ends. Keys are split by time: sums run within buckets
    of ``hours``, and only the totals of buckets, one row for each key and bucket, are added up along time.
    """
    wide = hours * 3600
    timed = events.select(key, F.col(ts).alias("_at"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"), F.col(member).alias("_m")).where(F.col("_m").isNotNull() & F.col("_s").isNotNull())
    mine = timed.select(key, "_m", "_s").distinct()
    before = F.lag("_s").over(Window.partitionBy(key, "_m").orderBy("_s"))
    # the windows that start in (from, to] hold this event as the member's first one
    spans = mine.withColumn("_from", F.greatest(F.col("_s") - wide, F.coalesce(before + 1, F.col("_s") - wide)))
    change = spans.select(key, F.col("_from").alias("_s"), F.lit(1).alias("_d")).union(spans.select(key, (F.col("_s") + 1).alias("_s"), F.lit(-1).alias("_d")))
    change = change.groupBy(key, "_s").agg(F.sum("_d").alias("_d")).withColumn("_at", F.lit(None).cast(events.schema[ts].dataType))
    starts = timed.select(key, "_s", F.lit(0).cast("long").alias("_d"), "_at").distinct()
    points = change.unionByName(starts).withColumn("_b", F.floor(F.col("_s") / wide))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = points.groupBy(key, "_b").agg(F.sum("_d").alias("_d")).select(key, "_b", F.coalesce(F.sum("_d").over(earlier), F.lit(0)).alias("_base"))
    running = Window.partitionBy(key, "_b").orderBy("_s").rangeBetween(Window.unboundedPreceding, 0)
    counted = points.withColumn("_sum", F.sum("_d").over(running)).where(F.col("_at").isNotNull())
    found = counted.join(base, [key, "_b"]).withColumn("members", F.col("_base") + F.col("_sum")).where(F.col("members") >= least)
    return found.groupBy(key).agg(F.min("_at").alias("start_at"), F.min_by("members", "_at").alias("members"))


def coherence(events: DataFrame, thread: str, item: str, tokens: str) -> DataFrame:
    """(thread, item, coherence): the mean similarity of each item's tokens to those of the thread's other items; a thread of one item has none.

    Items meet by the tokens that they share: pairs without a common token add 0 and are only counted.
    """
    sizes = events.groupBy(thread).agg(F.count("*").alias("_n"))
    words = events.select(thread, item, F.size(tokens).alias("_size"), F.explode(F.array_distinct(tokens)).alias("_token"))
    a, b = words.toDF(thread, item, "_x", "_token"), words.toDF(thread, "_other", "_y", "_token")
    shared = a.join(b, [thread, "_token"]).where(F.col(item) != F.col("_other")).groupBy(thread, item, "_other", "_x", "_y").agg(F.count("*").alias("_i"))
    sums = shared.groupBy(thread, item).agg(F.sum(F.col("_i") / (F.col("_x") + F.col("_y") - F.col("_i"))).alias("_sum"))
    found = events.select(thread, item).join(sizes, thread).where("_n > 1").join(sums, [thread, item], "left")
    return found.select(thread, item, (F.coalesce("_sum", F.lit(0.0)) / (F.col("_n") - 1)).alias("coherence"))


def confidence(members, domains):
    return F.least(F.lit(0.95), 0.55 + F.least(F.lit(0.25), (members - 2) * 0.08) + F.when(domains >= 2, 0.1).otherwise(0.05))


def breaker_states(events: DataFrame, key: str, ts: str, tie: str, failed, limit: int = 5) -> DataFrame:
    """For each key: failures in a row at the end, the longest such run, and whether the breaker is open (``limit`` in a row at the end)."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    marked = events.withColumn("_f", failed.cast("int"))
    runs = marked.withColumn("_run", F.sum(1 - F.col("_f")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lengths = runs.groupBy(key, "_run").agg(F.sum("_f").alias("n"))
    return lengths.groupBy(key).agg(F.max_by("n", "_run").alias("failures"), F.max("n").alias("longest")).withColumn("is_open", F.col("failures") >= limit)
