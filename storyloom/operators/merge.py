"""Merges without MERGE: a full outer join with one rule for each column; the result is the next version of the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def add(old: Column, new: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def largest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def smallest(old: Column, new: Column) -> Column:
    return F.least(old, new)


def replace(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep(old: Column, new: Column) -> Column:
    return F.coalesce(old, new)


def merged(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule], locked: Column | None = None) -> DataFrame:
    """``old`` and ``new`` by ``keys``, which are unique in each; ``locked``, over the old columns, keeps such rows as they are."""
    a, b = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    fixed = F.lit(False) if locked is None else F.coalesce(locked, F.lit(False))
    columns = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    columns += [F.when(fixed, F.col(f"o.{c}")).otherwise(rule(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c, rule in rules.items()]
    return joined.select(*columns)


def reconciled(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state): present, missing (expected only) or unreferenced (actual only)."""
    a, b = expected.select(F.col(key).alias("e")).distinct(), actual.select(F.col(key).alias("x")).distinct()
    state = F.when(F.col("x").isNull(), "missing").when(F.col("e").isNull(), "unreferenced").otherwise("present")
    return a.join(b, F.col("e") == F.col("x"), "full_outer").select(F.coalesce("e", "x").alias(key), state.alias("state"))
