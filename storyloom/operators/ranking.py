"""Scores of story clusters: seven parts, bonuses, order and lead. A cluster is a row with nested sources; all are column expressions over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import scoring

# Weights of the source tiers 0 to 4 (official, specialist, social, national, open), words and limits of the score.
TIER_WEIGHT = (1.0, 0.6, 0.85, 0.7, 0.5)
STRATEGIC_WORDS = (
    "lac", "loc", "nuclear", "triad", "ssbn", "amca", "project 75i", "brahmos", "dac", "ccs", "s-400", "hypersonic", "deterrence",
    "indigenous", "zorawar", "carrier", "iadc", "theatre command",
)
BORDER_WORDS = ("lac", "loc", "ladakh", "arunachal")
CLEARANCE = r"dac|defence acquisition council|ccs approval|acceptance of necessity|aon"
PURCHASE = r"procurement|acquisition|tender"
PURCHASED = r"defence|defense|mod|iaf|navy|army|drdo|missile|aircraft|warship|ammunition|howitzer|tank|drone|uav|submarine"
BONUSES = {"official": 20, "social": 15, "clearance": 15, "border": 15, "breaking": 15, "promoted": 25, "ignored": -20}
AUTOPILOT = 75
OFFICIAL, SOCIAL, NATIONAL = 0, 2, 3


def tier_weight(tier: Column) -> Column:
    return F.coalesce(F.element_at(F.array(*map(F.lit, TIER_WEIGHT)), tier.cast("int") + 1), F.lit(0.5))


def authority_class(tier: Column) -> Column:
    """official, social, trusted, standard, or unknown for a tier that is none."""
    return F.when(tier == OFFICIAL, "official").when(tier == SOCIAL, "social").when(tier == NATIONAL, "trusted").when(tier.isin(1, 4), "standard").otherwise("unknown")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def authority(primary: Column, related: Column) -> Column:
    """Weight of the primary source alone, or six tenths of it and four tenths of the related ones' mean; sources have tier and multiplier."""
    one = lambda s: F.least(F.lit(100.0), tier_weight(s["tier"]) * 100.0 * s["multiplier"])
    mean = total(F.transform(related, one)) / F.greatest(F.lit(1), F.size(related))
    return F.floor(F.when(F.size(related) == 0, one(primary)).otherwise(one(primary) * 0.6 + mean * 0.4) + 0.5)


def velocity(sources: Column, now: Column) -> Column:
    """A step of the sum of weight by age over sources at most six hours old; ages count as half an hour at least. Times are in minutes."""
    age = lambda s: (now - s["published_min"]) / 60.0
    recent = F.filter(sources, lambda s: age(s).between(0, 6))
    speed = total(F.transform(recent, lambda s: tier_weight(s["tier"]) / F.greatest(F.lit(0.5), age(s))))
    return F.when(speed >= 4.5, 100).when(speed >= 3.0, 75).when(speed >= 1.5, 50).otherwise(20)


def brief(points: Column, questions: Column, why: Column, takeaway: Column) -> Column:
    """How complete a cluster's brief is: reason, points, questions and a takeaway, 25 each (15 for a single point or question)."""
    listed = lambda n: F.when(n >= 2, 25).when(n == 1, 15).otherwise(0)
    return F.when(F.length(F.trim(F.coalesce(why, F.lit("")))) > 10, 25).otherwise(0) + listed(points) + listed(questions) + F.when(takeaway, 25).otherwise(0)


def discussion(n: Column) -> Column:
    return F.when(n >= 2, 100).when(n == 1, 50).otherwise(0)


def strategic(categories: Column, text: Column, words: tuple[str, ...] = STRATEGIC_WORDS) -> Column:
    """Points of a cluster's categories and of words that its lower-case text holds, 15 each up to 40."""
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])
    given = reduce(lambda a, b: a + b, [F.when(F.array_contains(categories, c), n).otherwise(0) for c, n in (("strategic", 25), ("procurement", 20), ("tech", 15))])
    return F.least(F.lit(100), given + F.least(F.lit(40), hits * 15))


def passes_rumour_gate(sources: Column) -> Column:
    """At least one source of the first tiers or two national ones."""
    count = lambda *tiers: F.size(F.filter(sources, lambda s: s["tier"].isin(*tiers)))
    return (count(OFFICIAL, SOCIAL) >= 1) | (count(NATIONAL) >= 2)


def word(text: Column, pattern: str) -> Column:
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])")


def scored(clusters: DataFrame, now: Column, gravity: float = 1.6, bonuses: dict[str, int] | None = None) -> DataFrame:
    """Adds the parts of the score, ``bonus`` and ``score`` (one digit, not below 0) to clusters.

    A cluster has primary and related sources (tier, multiplier, published_min), headline, entities, categories, updated_min, discussions, points, questions, why, takeaway,
    promoted and ignored. Bonuses count an official primary source, a social one among the sources, clearances, the border, and fast coverage that is more than a rumour.
    """
    give = BONUSES | (bonuses or {})
    sources = F.concat(F.array("primary"), F.col("related"))
    text = F.lower(F.concat_ws(" ", "headline", F.array_join("entities", " ")))
    found = clusters.withColumn("_sources", sources).withColumn("_text", text)
    s, t = F.col("_sources"), F.col("_text")
    found = found.withColumns({
        "authority": authority(F.col("primary"), F.col("related")), "source_count": scoring.source_count(F.size(s)), "recency": scoring.recency((now - F.col("updated_min")) / 60.0, gravity),
        "brief": brief(F.col("points"), F.col("questions"), F.col("why"), F.col("takeaway")), "strategic": strategic(F.col("categories"), t), "velocity": velocity(s, now), "discussion": discussion(F.col("discussions")),
    })
    applies = {
        "official": F.col("primary.tier") == OFFICIAL, "social": F.exists(s, lambda x: x["tier"] == SOCIAL), "clearance": word(t, CLEARANCE) | (word(t, PURCHASE) & word(t, PURCHASED)),
        "border": reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in BORDER_WORDS]), "breaking": (F.col("velocity") >= 50) & passes_rumour_gate(s), "promoted": F.col("promoted"), "ignored": F.col("ignored"),
    }
    bonus = reduce(lambda a, b: a + b, [F.when(F.coalesce(x, F.lit(False)), give[k]).otherwise(0) for k, x in applies.items()])
    parts = (("authority", 0.25), ("source_count", 0.20), ("recency", 0.15), ("brief", 0.15), ("strategic", 0.10), ("velocity", 0.10), ("discussion", 0.05))
    base = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in parts])
    return found.withColumn("bonus", bonus).withColumn("score", F.greatest(F.lit(0.0), scoring.rounded(base + F.col("bonus"), 1))).drop("_sources", "_text")


def autopilot(clusters: DataFrame, least: float = AUTOPILOT) -> DataFrame:
    return clusters.where(~F.coalesce("ignored", F.lit(False)) & (F.col("score") >= least))


def with_lead(ranked: DataFrame) -> DataFrame:
    """Adds ``is_lead``: the first position that is not ignored. One row is found by an aggregate and joined."""
    first = ranked.where(~F.coalesce("ignored", F.lit(False))).agg(F.min("position").alias("_lead"))
    return ranked.join(F.broadcast(first), F.lit(True)).withColumn("is_lead", F.coalesce(F.col("position") == F.col("_lead"), F.lit(False))).drop("_lead")
