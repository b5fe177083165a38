"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget of words. Whole copies of the source fill it as far as they go. For the rest,
documents are counted by exact length, an even share of each length is taken, and a bounded-knapsack dynamic
program over the small remaining budget picks how many more of which length. Which documents of a length are
taken follows a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._spark import ROW, WHOLE, Scratch, placed_rows, written

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a (source, length) group, so that a group with very many documents is ranked in parts.
BUCKETS = 64
#: Sums that the dynamic program goes through at least, where a source has as many words.
SUMS = 1 << 18


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come as near to ``budget`` as they can from below.

    ``sizes`` are distinct and positive. An even share of all counts comes first, then large sizes fill what is
    left down to a few documents, and the dynamic program does the rest: ``reach`` marks
    the sums that can be made, one layer for each size, with multiples split into powers of two.
    """
    order = np.argsort(sizes)
    sizes, counts = sizes[order].astype(np.int64), counts[order].astype(np.int64)
    total = int(sizes @ counts)
    budget = max(0, min(int(budget), total))
    width = max(SUMS, int(4 * np.median(sizes))) if len(sizes) else 0
    take = np.array([int(c) * budget // total if budget > width else 0 for c in counts], dtype=np.int64)
    left = budget - int(sizes @ take)
    for i in range(len(sizes) - 1, -1, -1):
        if left <= width:
            break
        more = min(int(counts[i] - take[i]), (left - width) // int(sizes[i]))
        take[i] += more
        left -= more * int(sizes[i])
    spare = counts - take
    items = [(i, 1 << k) for i in range(len(sizes)) for k in range(int(min(spare[i], left // sizes[i])).bit_length())]
    items = [(i, n) for i, n in items if n * sizes[i] <= left]
    # The last power of two would overshoot the spare count: it is replaced by what is left of the count.
    fixed, used = [], np.zeros(len(sizes), dtype=np.int64)
    for i, n in items:
        n = int(min(n, min(spare[i], left // sizes[i]) - used[i]))
        if n > 0:
            fixed.append((i, n))
            used[i] += n
    reach = np.zeros(left + 1, dtype=bool)
    reach[0] = True
    came_by = np.full(left + 1, -1, dtype=np.int32)
    for k, (i, n) in enumerate(fixed):
        step = n * int(sizes[i])
        new = np.zeros_like(reach)
        new[step:] = reach[: left + 1 - step]
        new &= ~reach
        came_by[new] = k
        reach |= new
        if reach[left]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:  # a sum is first reached by its own layer, from a sum of an earlier layer
        i, n = fixed[came_by[at]]
        take[i] += n
        at -= n * int(sizes[i])
    out = np.empty_like(take)
    out[order] = take
    return out


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    budget = int(np.floor(group["target"].iloc[0] + 0.5)) - int(group["copies"].iloc[0]) * int(group["source_size"].iloc[0])
    group = group.sort_values("size", ignore_index=True)
    take = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), budget)
    return pd.DataFrame({"source_rank": group["source_rank"], "size": group["size"], "take": take})


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float, scratch: Scratch) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, source_size).

    Sources are ranked by code point, null last, and take ``weights`` in turn. They share ``share`` times all
    words by weight; a target stops at ``most`` times its source, and the excess goes to the others by weight until
    none is above. ``totals`` has one row for each source; only scalars of it come to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = totals.withColumn("source_rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = scratch.written(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    capped, level = -1, 0.0
    while True:
        above = F.col("weight") * F.lit(level) > F.col("cap")
        n, full, free = ranked.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, max(level, (share * everything - (full or 0.0)) / free)
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("weight", "cap")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of each row of ``docs`` (doc_id, text, source).

    A null text and a text without words have size 0; such rows are kept and take 0 words, in one copy if whole
    copies of their source are taken. A null source is a source of its own. Rows that repeat a doc_id count and
    are taken one by one, and so are rows with a null one. ``taken`` is ``copies`` times ``size``, at most ``most`` times the size (``most`` is a whole number here,
    so that the part beyond whole copies adds one copy at most). An empty table yields no rows.
    """
    scratch = Scratch()
    sizes = scratch.written(_sizes(docs).withColumn(ROW, F.monotonically_increasing_id()), "sizes")
    found = _mixed(sizes, weights, share, most, seed).drop(ROW)
    scratch.close()
    return found


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs``, all columns, as often as the mix takes it. Rows that repeat a doc_id or have none are taken one by one."""
    rows, scratch = placed_rows(docs, "rows"), Scratch()
    copies = _mixed(scratch.written(_sizes(rows.select(ROW, f"{WHOLE}.doc_id", f"{WHOLE}.source", f"{WHOLE}.text"), ROW), "sizes"))
    scratch.close()
    # one row for each document on both sides: never broadcast, at no size
    taken = rows.join(copies.where("copies > 0").select(ROW, "copies").hint("merge"), ROW)
    return taken.select(WHOLE, F.explode(F.sequence(F.lit(1), "copies"))).select(f"{WHOLE}.*")


def _sizes(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        *more,
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def _mixed(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """The columns of ``mix`` and ROW of each row of ``sizes`` (ROW, doc_id, source, size)."""
    scratch = Scratch()
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most, scratch)
    targets = scratch.written(targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("long")), "targets")

    same = sizes["source"].eqNullSafe(targets["source"])
    # targets has one row for each source; Spark broadcasts it by its measured size or splits the hot source
    ranked = scratch.written(
        sizes.join(targets.select("source", "source_rank"), same).drop(targets["source"]).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce("doc_id", ROW))),
        "ranked",
    ).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    lengths = ranked.where("size > 0").groupBy("source_rank", "size").agg(F.count("*").alias("n"))
    lengths = lengths.join(targets, "source_rank").select("source_rank", "size", "n", "target", "copies", "source_size")
    picks = lengths.groupBy("source_rank").applyInPandas(_fit, "source_rank int, size long, take long")

    keys = ["source_rank", "size"]
    by_bucket = ranked.where("size > 0").groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = by_bucket.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    quota = by_bucket.join(picks, keys).select(*keys, "bucket", (F.col("take") - F.col("before")).alias("quota")).where("quota > 0")
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("h", "doc_id", ROW)
    chosen = (
        ranked.withColumn("at", F.row_number().over(in_bucket))
        .join(scratch.written(quota, "quota"), [*keys, "bucket"], "left")
        .withColumn("extra", (F.col("at") <= F.coalesce("quota", F.lit(0))).cast("long"))
    )
    found = chosen.join(targets.drop("source"), "source_rank").select(
        ROW, "doc_id", "source", "size", "source_size", "target", ((F.col("copies") + F.col("extra")) * F.col("size")).alias("taken"),
        (F.col("copies") + F.col("extra")).alias("copies"),
    )
    found = written(found, "mixed")
    scratch.close()
    return found
