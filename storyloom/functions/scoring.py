"""Score expressions. Rounding is half up on doubles, by ``floor``, so that other engines give the same values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 4) -> Column:
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(age_hours: Column, gravity: float = 1.6) -> Column:
    """100 for new articles, 50 after four hours, with one digit; ages below 0 count as 0."""
    return rounded(100.0 / (1.0 + F.pow(F.greatest(F.lit(0.0), age_hours) / 4.0, F.lit(gravity))), 1)


def source_count(n: Column) -> Column:
    return F.when(n <= 1, 25).when(n == 2, 50).when(n == 3, 70).when(n == 4, 85).otherwise(F.least(F.lit(100), 85 + (n - 4) * 5))


def reputation(ingested: Column, accepted: Column, scoops: Column, corroborations: Column) -> Column:
    """A multiplier from 0.7 to 1.3: share of accepted items, scoops and corroborations."""
    ratio = accepted / F.greatest(F.lit(1), ingested)
    band = F.when(ratio < 0.15, -0.15).when(ratio < 0.35, -0.08).when(ratio >= 0.75, 0.08).otherwise(0.0)
    raw = 1.0 + band + F.least(F.lit(0.15), scoops * 0.03) + F.least(F.lit(0.10), corroborations * 0.01)
    return F.when(ingested <= 0, 1.0).otherwise(rounded(clamp(raw, 0.7, 1.3), 2))


def link_confidence(mentions: Column, sources: Column) -> Column:
    return rounded(F.least(F.lit(1.0), 0.3 + 0.15 * mentions + 0.1 * sources), 4)
