"""Hard negatives for anchors and their positives, by distributed radix selection over whole-number scores.

Rows are packed into blocks, anchors into groups, and each group meets every block; the scores of a meeting are recomputed in each round and never
stored. A window of scores belongs to each anchor and positive. In a round, meetings count the scores of a window by its next eight bits; the sums tell
which bucket holds the k-th best score, and the window shrinks to it. When each window is a single score, one last round gathers the rows above it and
of those at it as many as are missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._spark import Scratch, is_empty, written
from storyloom.llm._vectors import finite, matrix, usual_length

#: Rows of a block and anchors of a group.
BLOCK, GROUP = 8192, 512
#: Bits that a round decides.
DIGIT = 8
#: Stands for a null vec_id, which comes last among equal scores.
NO_ID = np.iinfo(np.int64).max
#: No score leaves this.
LARGEST = 1 << 60


def whole_vectors(df: DataFrame, vec_id: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, label, x): rows that take part, each component c as the long floor(scale * c).

    Rows with a null label, a null or empty vector, or a null or non-finite component are left out, and so are vectors of another length than most have. Components are
    held within what keeps inner products below 2**60.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & finite("v"))
    length = usual_length(rows, "v")
    most = float(int((LARGEST / max(1, length)) ** 0.5))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(scale * c.cast("double"), F.lit(most)), F.lit(-most))).cast("long"))
    return rows.where(F.size("v") == length).select("vec_id", "label", x.alias("x"))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The inner products of whole-number vectors as longs, exact: no sum exceeds the product of the largest norms."""
    norm = lambda m: float(np.sqrt((m.astype(float) ** 2).sum(axis=1).max(initial=0)))
    bound = norm(anchors) * norm(rows) * 1.001
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def _packed(rows: DataFrame, name: str, size: int) -> DataFrame:
    """One row for each ``name``: ``rows`` (row, vec_id, label, x) dealt by a hash of their numbers, about ``size`` together."""
    parts = max(1, -(-rows.count() // size))
    return rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(name)).agg(F.collect_list(F.struct("row", "vec_id", "label", "x")).alias(f"{name}_rows"))


class _Members:
    """The rows of a block or a group as arrays, by rising vec_id, null ones last."""

    def __init__(self, cell: pa.ListScalar):
        rows = cell.values
        ids = rows.field("vec_id").fill_null(NO_ID).to_numpy()
        order = np.lexsort((rows.field("row").to_numpy(), ids))
        self.ids, self.row, self.label = ids[order], rows.field("row").to_numpy()[order], rows.field("label").to_numpy()[order]
        self.x = matrix(rows.field("x"))[order]


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _positives(most: int):
    """For each anchor the first ``most`` other rows of its label in the block."""
    schema = pa.schema({"group": pa.int32(), "anchor_row": pa.int64(), "positive_row": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64()})

    def run(table: pa.Table) -> pa.Table:
        anchors, block = _Members(table.column("group_rows")[0]), _Members(table.column("block_rows")[0])
        found, none = scores(anchors.x, block.x), np.iinfo(np.int64).min
        found[(anchors.label[:, None] != block.label[None, :]) | (anchors.row[:, None] == block.row[None, :])] = none
        out, every = ([], [], []), np.arange(len(found))
        for _ in range(min(most, found.shape[1])):
            at = found.argmax(axis=1)  # of equal scores the first, which has the smallest id
            best, there = found[every, at], found[every, at] > none
            for cells, values in zip(out, (anchors.row[there], at[there], best[there])):
                cells.append(values)
            found[every, at] = none
        row, at, score = (np.concatenate(x) for x in out)
        group = pa.array(np.full(len(row), table.column("group")[0].as_py()), pa.int32())
        return pa.table([group, pa.array(row), pa.array(block.row[at]), _ids(block.ids[at]), pa.array(score)], schema=schema)

    return run, "group int, anchor_row long, positive_row long, positive_id long, positive_score long"


def _negatives(anchors: _Members, block: _Members, windows: pa.StructArray):
    """For each window its fields, and the scores and places of the block's rows of other labels inside it."""
    found, order = scores(anchors.x, block.x), np.argsort(anchors.row)
    at = order[np.searchsorted(anchors.row, windows.field("anchor_row").to_numpy(), sorter=order)]
    fields = [windows.field(f).to_numpy() for f in ("anchor_row", "positive_row", "lo", "hi", "need")]
    last, other, own = -1, None, None
    for k in np.argsort(at, kind="stable"):
        if at[k] != last:
            last = at[k]
            other = np.flatnonzero(block.label != anchors.label[last])
            own = found[last, other]
        anchor, positive, lo, hi, need = (f[k] for f in fields)
        inside = np.flatnonzero((own >= lo) & (own <= hi))
        yield int(anchor), int(positive), int(lo), int(hi), int(need), own[inside], other[inside]


def _digit(lo, hi):
    """The bits below the digit that is decided next in a window."""
    return max(0, (hi - lo).bit_length() - DIGIT)


def _counts():
    """(anchor_row, positive_row, bucket, n): counts by the next digit of what a score lacks to its window's top.

    Buckets behind the one where the block itself reaches the number that is needed cannot hold the score looked for, so they are not sent.
    """

    def run(table: pa.Table) -> pa.Table:
        anchors, block = _Members(table.column("group_rows")[0]), _Members(table.column("block_rows")[0])
        out = ([], [], [], [])
        for anchor, positive, lo, hi, need, values, _ in _negatives(anchors, block, table.column("windows")[0].values):
            n = np.bincount((hi - values) >> _digit(lo, hi), minlength=1)
            n = n[: int(np.searchsorted(np.cumsum(n), need)) + 1]
            buckets = np.flatnonzero(n)
            for cells, cell in zip(out, (np.full(len(buckets), anchor), np.full(len(buckets), positive), buckets, n[buckets])):
                cells.append(cell)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["anchor_row", "positive_row", "bucket", "n"])

    return run, "anchor_row long, positive_row long, bucket long, n long"


def _gathered():
    """(anchor_row, positive_row, negative_row, negative_id, negative_score): all rows above what is left of a window, its score ``lo``, and the first ``need`` at it."""
    schema = pa.schema({"anchor_row": pa.int64(), "positive_row": pa.int64(), "negative_row": pa.int64(), "negative_id": pa.int64(), "negative_score": pa.int64()})

    def run(table: pa.Table) -> pa.Table:
        anchors, block = _Members(table.column("group_rows")[0]), _Members(table.column("block_rows")[0])
        out = ([], [], [], [])
        for anchor, positive, lo, _, need, values, at in _negatives(anchors, block, table.column("windows")[0].values):
            keep = np.concatenate([np.flatnonzero(values > lo), np.flatnonzero(values == lo)[:need]])
            for cells, cell in zip(out, (np.full(len(keep), anchor), np.full(len(keep), positive), at[keep], values[keep])):
                cells.append(cell)
        anchor, positive, at, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table([pa.array(anchor), pa.array(positive), pa.array(block.row[at]), _ids(block.ids[at]), pa.array(score)], schema=schema)

    return run, "anchor_row long, positive_row long, negative_row long, negative_id long, negative_score long"


def _windows(positives: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """The scores from ``low`` to ``high`` hundredths of each positive's, as whole numbers ``lo`` to ``hi``; windows without any are left out."""
    rest = F.pmod(F.col("positive_score"), F.lit(100))
    whole = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    lo, hi = low * whole + F.ceil(low * rest / 100), high * whole + F.floor(high * rest / 100)
    found = positives.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long"), "need": F.lit(k).cast("long")})
    return found.withColumn("top", F.col("hi")).where("lo <= hi")


def _narrowed(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each open window (lo < hi) shrunk to the bucket that holds the score looked for; to its lowest score if it holds fewer rows than needed."""
    keys = ["anchor_row", "positive_row"]
    upward = Window.partitionBy(*keys).orderBy("bucket")
    reach = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upward))
    found = windows.join(reach, keys, "left").withColumn("hit", F.col("upto") >= F.col("need"))
    found = found.groupBy(*windows.columns).agg(F.min(F.when(F.col("hit"), F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")))).alias("hit"))
    bits = F.greatest(F.lit(0), F.length(F.bin(F.col("hi") - F.col("lo"))) - DIGIT)
    step = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    top = F.col("hi") - F.col("hit.bucket") * step
    hit = F.col("hit").isNotNull()
    narrow = {"hi": F.when(hit, top).otherwise(F.col("lo")), "lo": F.when(hit, F.greatest("lo", top - step + 1)).otherwise(F.col("lo")), "need": F.when(hit, F.col("need") - F.col("hit.before")).otherwise(F.col("need"))}
    return found.withColumns(narrow).select(*windows.columns)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    df: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", block: int = BLOCK, group: int = GROUP
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), a row for each hard negative.

    ``anchors`` is a condition on (vec_id, label). An anchor's positives are its first ``positives`` other rows of its label; a positive's negatives are the first ``k`` rows of
    other labels that score between ``low`` and ``high`` hundredths of what it scores (all, if there are fewer). Higher scores come first, then smaller vec_ids, null ones last.
    Rows that repeat a vec_id are rows of their own. ``whole_vectors`` says which rows take part. An empty table, or no anchor, yields no rows.
    """
    scratch = Scratch()
    rows = scratch.written(whole_vectors(df, vec_id, label, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    chosen = rows.where(F.coalesce(anchors, F.lit(False)))
    if is_empty(chosen):
        scratch.close()
        return df.sparkSession.createDataFrame([], RESULT)
    blocks, groups = scratch.written(_packed(rows, "block", block), "blocks"), scratch.written(_packed(chosen, "group", group), "groups")
    last = blocks.agg(F.max("block")).first()[0]

    def meet(groups: DataFrame, work) -> DataFrame:
        """Each group with each block: a stated set of queries against all rows, in blocks."""
        run, schema = work
        each = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).repartition(last + 1, "block")
        return each.join(blocks.repartition(last + 1, "block").hint("merge"), "block").groupBy("block", "group").applyInArrow(run, schema)

    def asked(windows: DataFrame) -> DataFrame:
        cells = F.collect_list(F.struct("anchor_row", "positive_row", "lo", "hi", "need")).alias("windows")
        return groups.join(windows.groupBy("group").agg(cells).hint("merge"), "group")

    best = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    near = meet(groups, _positives(positives)).withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives).drop("at")
    windows = scratch.written(_windows(near, low, high, k), "windows")
    while not is_empty(open_ := windows.where("lo < hi")):
        # at most eight rounds, as a score has 62 bits
        narrow = _narrowed(open_, meet(asked(open_), _counts()))
        windows = scratch.written(narrow.unionByName(windows.where("lo = hi")), "windows")
    full = windows.withColumn("hi", F.col("top"))
    found = scratch.written(meet(asked(full), _gathered()), "negatives")
    best = Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    result = ranked.join(windows.select("anchor_row", "positive_row", "positive_id", "positive_score"), ["anchor_row", "positive_row"])
    result = result.join(chosen.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    result = written(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    scratch.close()
    return result
