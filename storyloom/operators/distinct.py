"""Counts of distinct values that add up over runs: exact up to a bound, a sketch beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: So many different values are kept as they are.
EXACT = 256
#: Registers of a sketch are 2 ** this: a standard error of about 1.6 %.
SKETCH_BITS = 12


def distinct_states(rows: DataFrame, keys: list[str], value: str, exact: int = EXACT) -> DataFrame:
    """(keys, values, sketch): of each key its different values, sorted, or null if there are more than ``exact``; and a sketch of them all. Null values do not count.

    No more than ``exact`` + 1 values of a key leave a task or are gathered, so a hot key costs as little as any.
    """
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("_v"))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_v"))
    few = known.distinct().withColumn("_r", rank).where(F.col("_r") <= exact + 1).groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("values"))
    few = few.withColumn("values", F.when(F.size("values") <= exact, F.col("values")))
    sketches = known.groupBy(*keys).agg(F.hll_sketch_agg("_v", F.lit(SKETCH_BITS)).alias("sketch"))
    every = rows.select(*keys).distinct()
    on = lambda a, b: a.join(b, keys, "left")
    found = on(on(every, sketches), few)
    return found.select(*keys, F.when(F.col("sketch").isNull(), F.array().cast("array<string>")).otherwise(F.col("values")).alias("values"), "sketch")


def merged_values(old: Column, new: Column, fresh: Column, exact: int = EXACT) -> Column:
    """The values of both states, if both have theirs and together there are ``exact`` at most; ``fresh`` tells that there was no old state."""
    both = F.array_sort(F.array_union(old, new))
    return F.when(fresh, new).when(F.size(both) <= exact, both)


def merged_sketches(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.hll_union(old, new))


def distinct_count(values: Column, sketch: Column) -> Column:
    """The number of different values: exact where they are known, else what the sketch says. It is read in its merged form, so that the order and number of merges make no difference."""
    return F.when(values.isNotNull(), F.size(values).cast("long")).otherwise(F.hll_sketch_estimate(F.hll_union(sketch, sketch)))


# --- candidates that are found in run after run

VALID = "^[A-Za-z]"


def candidate_batch(mentions: DataFrame, default: str = "tech", exact: int = EXACT) -> DataFrame:
    """One run's state of each slug out of mentions (slug, name, category, domain, seen): mentions, values and sketch of their sources, times, and the first category that is not the default."""
    valid = mentions.where(F.length("name").between(3, 60) & F.col("name").rlike(VALID))
    special = F.when(F.col("category") != default, F.struct("seen", "category"))
    facts = valid.groupBy("slug").agg(F.count("*").alias("mentions"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.min(special).alias("special"))
    sources = distinct_states(valid.withColumn("domain", F.when(F.lower("domain") != "unknown", F.lower("domain"))), ["slug"], "domain", exact)
    return facts.join(sources, "slug")


def merged_candidates(table: DataFrame | None, batch: DataFrame, least: int = 3, sources: int = 2, exact: int = EXACT) -> DataFrame:
    """The table of candidates after a run: sums, times, states of sources, and whether a slug is promoted, which it stays."""
    if table is None:
        found = batch.withColumn("was", F.lit(False))
    else:
        o, n = table.alias("o"), batch.alias("n")
        j = o.join(n, F.col("o.slug") == F.col("n.slug"), "full_outer")
        gone = F.col("n.slug").isNull()
        found = j.select(
            F.coalesce("o.slug", "n.slug").alias("slug"), (F.coalesce("o.mentions", F.lit(0)) + F.coalesce("n.mentions", F.lit(0))).alias("mentions"), F.least("o.first_seen", "n.first_seen").alias("first_seen"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
            F.least("o.special", "n.special").alias("special"), F.when(gone, F.col("o.values")).otherwise(merged_values(F.col("o.values"), F.col("n.values"), F.col("o.slug").isNull(), exact)).alias("values"),
            merged_sketches(F.col("o.sketch"), F.col("n.sketch")).alias("sketch"), F.coalesce("o.promoted", F.lit(False)).alias("was"),
        )
    count = distinct_count(F.col("values"), F.col("sketch"))
    return found.withColumn("promoted", F.col("was") | ((F.col("mentions") >= least) & (count >= sources))).drop("was")


def candidate_table(table: DataFrame, default: str = "tech") -> DataFrame:
    """The table as it is read: slug, mentions, sources, times, category, promoted."""
    return table.select("slug", "mentions", distinct_count(F.col("values"), F.col("sketch")).alias("sources"), "first_seen", "last_seen", F.coalesce(F.col("special.category"), F.lit(default)).alias("category"), "promoted")
