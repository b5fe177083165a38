"""Dossiers from milestones, conflicts between sources, and lookups by several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def synthesized(milestones: DataFrame, key: str, order: list[str], official: Column, recent: int = 3) -> DataFrame:
    """One row for each ``key``: the first official budget (else the first one), the latest timeline and share, and the
    newest status among the last ``recent`` milestones. Null values do not count; ``order`` must be total within a key.
    """
    at = F.struct(*order)

    def seen(name: str, which: Column | None = None) -> Column:
        known = F.col(name).isNotNull()
        return F.when(known if which is None else known & which, at)

    found = milestones.groupBy(key).agg(
        F.count("*").alias("milestones"),
        F.coalesce(F.min_by("budget", seen("budget", official)), F.min_by("budget", seen("budget"))).alias("budget"),
        F.max_by("timeline", seen("timeline")).alias("timeline"),
        F.max_by("share", seen("share")).alias("share"),
    )
    newest = Window.partitionBy(key).orderBy(*[F.col(name).desc() for name in order])
    last = milestones.select(key, *order, "status").withColumn("_at", F.row_number().over(newest)).where(F.col("_at") <= recent)
    return found.join(last.groupBy(key).agg(F.max_by("status", seen("status")).alias("status")), key)


def timeline_conflicts(milestones: DataFrame, key: str, order: list[str], official: Column) -> DataFrame:
    """Milestones that are not official and whose timeline differs from the latest official one of their ``key``."""
    latest = milestones.where(official & F.col("timeline").isNotNull()).groupBy(key).agg(F.max_by("timeline", F.struct(*order)).alias("official_timeline"))
    return milestones.where(~F.coalesce(official, F.lit(False))).join(latest, key).where(F.col("timeline") != F.col("official_timeline"))


def both_ways(links: DataFrame, a: str, b: str) -> DataFrame:
    """A symmetric relation, each direction once."""
    return links.select(a, b).union(links.select(F.col(b).alias(a), F.col(a).alias(b))).where(F.col(a) != F.col(b)).distinct()


def first_match(rows: DataFrame, others: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``value`` of the row of ``others`` that agrees in the first of ``keys`` to agree in any; null without a match.

    Each key is an equality join of its own with one row (the least value) for each key, so a key shared by very many
    rows multiplies nothing. Nulls match nothing.
    """
    found = rows
    for k, name in enumerate(keys):
        hits = others.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias(f"_hit{k}"))
        found = found.join(hits, name, "left")
    hits = [f"_hit{k}" for k in range(len(keys))]
    return found.withColumn(value, F.coalesce(*hits)).drop(*hits)


def freshest(copies: DataFrame, key: str, at: str, preference: str) -> DataFrame:
    """For each key the newest copy; ties go to the smallest ``preference``."""
    rest = [c for c in copies.columns if c != key]
    best = copies.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.unix_micros(F.col(at).cast("timestamp")), preference)).alias("_best"))
    return best.select(key, *[F.col("_best")[c].alias(c) for c in rest])


def best_overlaps(texts: DataFrame, topics: DataFrame, id_: str, topic: str, tokens: str, n: int) -> DataFrame:
    """The ``n`` topics that share most distinct tokens with each text; ties go to the smaller topic."""
    words = texts.select(id_, F.explode(F.array_distinct(tokens)).alias("_token"))
    shared = words.join(topics.select(topic, F.explode(F.array_distinct(tokens)).alias("_token")), "_token").groupBy(id_, topic).agg(F.count("*").alias("shared"))
    order = Window.partitionBy(id_).orderBy(F.col("shared").desc(), topic)
    return shared.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= n)
