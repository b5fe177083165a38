"""Filters, dedupe, ranking and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fresh(df: DataFrame, age: Column, most: float) -> DataFrame:
    """Rows at most ``most`` old; unknown ages and those from the future stay."""
    return df.where(age.isNull() | (age <= most))


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")


#: Rows of one key that meet each other in one task.
PAIRED = 4096


def pairs_of_equals(df: DataFrame, key: str, order: str, paired: int = PAIRED) -> DataFrame:
    """(later, earlier): all pairs of rows with equal ``key``, by ``order``; null keys are equal to nothing.

    Rows of a key are dealt to blocks of about ``paired``, and each two blocks meet in a part of their own: the number of pairs is that of the result, but a part is bounded however many rows a key has.
    """
    known = df.select(key, order).where(F.col(key).isNotNull())
    large = known.groupBy(key).agg(F.ceil(F.count("*") / paired).alias("_of")).where("_of > 1")
    dealt = known.join(F.broadcast(large), key, "left").withColumn("_of", F.coalesce("_of", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(order), "_of"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1))
    a = dealt.select(key, F.col("_own").alias("_a"), every.alias("_b"), F.col(order).alias("later"))
    b = dealt.select(key, every.alias("_a"), F.col("_own").alias("_b"), F.col(order).alias("earlier"))
    # small tables make many pairs: a number of parts that is asked for is neither broadcast nor put together
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = [x.repartition(parts, key, "_a", "_b") for x in (a, b)]
    return a.join(b.hint("merge"), [key, "_a", "_b"]).where("later > earlier").select("later", "earlier")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that meet every given option; options that are None do not count."""
    tests = [F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None = None, size: int = 50) -> DataFrame:
    """A keyset page and one more row, which tells whether there is a next page. ``order``: (column, ascending), the last one unique.

    ``after`` is the last row of the page before. Nulls count as smaller than all values: they come first in ascending columns and last in
    descending ones, and ``after`` may have them.
    """
    if after is not None:
        found, same = F.lit(False), F.lit(True)
        for (name, up), value in zip(order, after):
            if value is None:
                later = F.col(name).isNotNull() if up else F.lit(False)
            else:
                later = F.col(name) > F.lit(value) if up else (F.col(name) < F.lit(value)) | F.col(name).isNull()
            found = found | (same & F.coalesce(later, F.lit(False)))
            same = same & F.col(name).eqNullSafe(F.lit(value))
        df = df.where(found)
    return df.orderBy(*[F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in order]).limit(size + 1)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def anti(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows that break ``rule``; an unknown outcome breaks it, too."""
    return df.where(~F.coalesce(rule, F.lit(False)))
