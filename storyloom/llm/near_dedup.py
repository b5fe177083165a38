"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets become one class. Classes are banded by MinHash signatures; within a bucket,
candidates are compared batch by batch of their signatures and dropped once the posterior probability that their
similarity reaches the threshold falls below ``MISS``. Survivors are verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._spark import ROW, WHOLE, Scratch, component_labels, is_empty, placed_rows, written
from storyloom.llm._words import WordHashes, mixed, run_hashes
from storyloom.llm.token_output import slices

#: A pair at a similarity of 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, 3e-6.
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signatures are compared so many values at a time; a pair is dropped at this posterior probability of a link.
STEP, MISS = 32, 1e-6
#: Members of one salted part of a bucket, and the compared pairs that share one copy of the first set.
PART, CHUNK = 512, 64
#: Buckets of at most so many members are compared pair by pair.
SMALL = 64
#: In larger ones, shingles that at most so many classes have are rare.
RARE = 256
#: Words of 64 bits that mark the common shingles of a class.
MARKS = 16

_rng = np.random.default_rng(2)
_MULTIPLY = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_hashes(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` lower-cased words; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(hashes.of(words), min(size, len(words))))


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        values = _MULTIPLY[:, None] * short[None, at : at + 2048]
        values += _ADD[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


@cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared values (STEP, 2 * STEP, ...), the fewest matches at which a pair goes on.

    With a uniform prior, the posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1); the
    pair is dropped if its mass from ``threshold`` on is below ``miss``.
    """
    grid = (np.arange(200_000) + 0.5) / 200_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() / mass.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for big in batches:
            for batch in slices(big, "text"):
                n, keys, signatures = [], [], []
                for text in batch.column("text").to_pylist():
                    h = shingle_hashes(text, size, hashes)
                    n.append(len(h))
                    # two sums over mixed hashes name the set, whatever its order
                    keys.append((int(mixed(h).sum(dtype=np.uint64).view(np.int64)), int(mixed(h ^ np.uint64(77)).sum(dtype=np.uint64).view(np.int64))) if len(h) else (0, 0))
                    signatures.append(signature(h).tobytes() if len(h) else None)
                a, b = zip(*keys)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(ROW), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signatures, pa.binary())],
                    [ROW, "doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for big in batches:
            for batch in slices(big, "text"):
                sets = [shingle_hashes(x, size, hashes).tobytes() for x in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "value"])

    return run


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, value in zip(batch.column("id").to_pylist(), batch.column("value").to_pylist()):
            found = np.frombuffer(value, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), id_)), pa.array(found)], ["id", "shingle"])


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(a, chunk, b, n, value): for each chunk of the pairs (a, b, chunk) one row of ``a`` itself (b null), then one for each b.

    A value of ``a`` is sent once for each chunk, and a hot ``a`` is spread over many chunks. ``values`` (id, n, value).
    """
    first = pairs.select("a", "chunk").distinct().join(values, F.col("a") == F.col("id")).select("a", "chunk", F.lit(None).cast("long").alias("b"), "n", "value")
    second = pairs.join(values, F.col("b") == F.col("id")).select("a", "chunk", "b", "n", "value")
    return first.union(second).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())


def _chunked(pairs: DataFrame) -> DataFrame:
    """(a, b, chunk) of the distinct pairs (a, b, m).

    ``m`` bounds the pairs that ``a`` may have in the bucket that gave the pair, so chunks are dealt without counting pairs.
    """
    once = pairs.groupBy("a", "b").agg(F.max("m").alias("m"))
    return once.select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), (F.col("m") / CHUNK).cast("long"))).alias("chunk"))


def _sizes_fit(one: str, other: str, hundredths: int):
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * F.least(one, other) >= hundredths * F.greatest(one, other)


def _probable(threshold: float):
    """Pairs (a, b, chunk) whose signatures stay above the posterior bound in every batch of values."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, n_a, sig = None, 0, None
        for batch in batches:
            out = ([], [], [])
            for this, chunk, b, n, value in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b", "n", "value"))):
                if b is None:
                    a, n_a, sig = this, n, np.frombuffer(value, np.uint32)
                    continue
                if this != a or 100 * min(n, n_a) < round(100 * threshold) * max(n, n_a):
                    continue
                other, matches = np.frombuffer(value, np.uint32), 0
                for k, bound in enumerate(least):
                    part = slice(k * STEP, (k + 1) * STEP)
                    matches += int(np.count_nonzero(sig[part] == other[part]))
                    if matches < bound:
                        break
                else:
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "chunk"])

    return run


def _verified(threshold: float):
    """Pairs (a, b) whose full sets have a similarity of ``threshold`` (in whole hundredths) or more."""
    hundredths = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, one = None, None
        for batch in batches:
            out = ([], [])
            for this, b, value in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "value"))):
                if b is None:
                    a, one = this, np.frombuffer(value, np.uint64)
                    continue
                if this != a:
                    continue
                other = np.frombuffer(value, np.uint64)
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= hundredths * (len(one) + len(other) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    return run


PAIR = "a long, b long"


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    A document's set are its distinct shingles of ``size`` words; with fewer words, all of them as one. Null texts and texts without
    words have empty sets and are linked with nothing. Rows are linked one by one, whatever their ids. ``component_id`` is the smallest doc_id
    that links reach, null if all are null, and ``kept`` marks the rows with that id, or one row if it is null. Rows that repeat a doc_id are
    in one component if links reach from one to the other; otherwise each is in its own, and both components may have that id. An
    empty table yields no rows.
    """
    scratch = Scratch()
    texts = scratch.written(docs.select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    found = _placed(texts, threshold, size)
    scratch.close()
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & F.col("leads"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """One row, all columns, of each component of ``docs``: of the smallest doc_id, nulls last.

    Rows with null ids and rows that repeat an id are rows like all others: copies go, others stay. A table that is read from files is not copied (``placed_rows``).
    """
    rows = placed_rows(docs, "rows")
    texts = rows.select(ROW, F.col(f"{WHOLE}.doc_id").cast("long").alias("doc_id"), F.col(f"{WHOLE}.text").cast("string").alias("text"))
    # a row for each component: never broadcast, at no size
    return rows.join(_placed(texts, threshold, size).where("leads").select(ROW).hint("merge"), ROW).select(f"{WHOLE}.*")


def _placed(texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """(ROW, doc_id, n_shingles, component_id, leads) of each row of ``texts`` (ROW, doc_id, text); ``leads`` marks one row of each component."""
    columns, scratch = [ROW, "doc_id", "text"], Scratch()
    sketch = scratch.written(texts.select(*columns).mapInArrow(_sketches(size), f"{ROW} long, doc_id long, n_shingles long, s1 long, s2 long, sig binary"), "sketch")
    full = sketch.where("n_shingles > 0")
    # copies: one class for each distinct set; a class of very many copies is counted by partial sums only
    lead = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc"), F.col(ROW).alias("row"))
    classes = scratch.written(full.groupBy("s1", "s2", "n_shingles").agg(F.min(ROW).alias("id"), F.min(lead).alias("lead")), "classes")
    # here and below, ids of many documents are merged at every size, so that small inputs run as large ones do
    reps = scratch.written(full.join(classes.select("id").hint("merge"), full[ROW] == F.col("id")).select("id", F.col("n_shingles").alias("n"), "sig"), "signatures")
    links = _links(texts, reps, threshold, size, scratch)
    if links is not None:
        linked = links.join(classes.select("id", "lead"), "id")
        first = links.join(linked.groupBy("component").agg(F.min("lead").alias("first")), "component").select("id", "first")
        classes = classes.join(first, "id", "left").withColumn("lead", F.coalesce("first", "lead"))
    keys = ["s1", "s2", "n_shingles"]
    labelled = full.drop("sig").join(classes.select(*keys, "lead"), keys)
    labelled = labelled.select(ROW, "doc_id", "n_shingles", F.col("lead.doc").alias("component_id"), (F.col(ROW) == F.col("lead.row")).alias("leads"))
    empty = sketch.where("n_shingles = 0").select(ROW, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("leads"))
    found = written(labelled.union(empty), "placed")
    scratch.close()
    return found


def _in_reach(most, hundredths: int):
    """Whether an intersection of ``most`` shingles is enough for the threshold."""
    return 100 * most >= hundredths * (F.col("n_a") + F.col("n_b") - most)


def _across(rows: DataFrame, key: str, condition=None) -> DataFrame:
    """Pairs of ``rows`` (key, id, n, component, common, m, marks) with one key and of two components; the columns have the ends _a and _b."""
    rows = rows.select(key, "id", "n", "component", "common", "m", *[c for c in rows.columns if c == "beside" or c.startswith("mark_")])
    left, right = rows.toDF(*[f"{c}_a" for c in rows.columns]), rows.toDF(*[f"{c}_b" for c in rows.columns])
    on = (F.col(f"{key}_a") == F.col(f"{key}_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b"))
    return left.join(right, on if condition is None else on & condition)


def _marked(common: DataFrame) -> DataFrame:
    """(id, marks, beside): the common shingles (id, shingle) of each class as set bits, and how many of them share a bit with others."""
    place = F.pmod("shingle", F.lit(64 * MARKS)).cast("int")
    bit, word = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64))), (place / 64).cast("int")
    marks = [F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0)).cast("long").alias(f"mark_{k}") for k in range(MARKS)]
    found = common.groupBy("id").agg(*marks, F.count("*").alias("own"))
    return found.withColumn("beside", F.col("own") - sum((F.bit_count(f"mark_{k}") for k in range(MARKS)), F.lit(0))).drop("own")


def _common_at_most():
    """The most common shingles that a pair can share: the bits that both have, and one more for each shingle that shares its bit."""
    bits = sum((F.bit_count(F.col(f"mark_{k}_a").bitwiseAND(F.col(f"mark_{k}_b"))) for k in range(MARKS)), F.lit(0))
    return F.least("common_a", "common_b", bits + F.least("beside_a", "beside_b"))


def _across_large(rows: DataFrame, sets: DataFrame, hundredths: int, scratch: Scratch) -> DataFrame:
    """(a, b, m): the pairs of large buckets that can reach the threshold; no other pair of them can.

    A shingle is rare if at most ``RARE`` of these classes have it. A pair's intersection has the rare shingles that it shares, and at most as many common ones as its marks allow.
    Pairs that share rare ones come from a join on them, which also counts them; all others have common ones only.
    """
    placed = rows.select("id", "n", "component").distinct()
    shingles = sets.join(placed.select("id"), "id").select("id", "value").mapInArrow(_exploded, "id long, shingle long")
    counted = scratch.written(shingles.groupBy("shingle").agg(F.count("*").alias("df")), "frequencies")
    rare = scratch.written(shingles.join(counted.where(F.col("df") <= RARE), "shingle"), "rare")
    marks = _marked(shingles.join(counted.where(F.col("df") > RARE), "shingle"))
    counts = rare.groupBy("id").agg(F.count("*").alias("rare"))
    common = F.col("n") - F.coalesce("rare", F.lit(0))
    placed = placed.join(counts, "id", "left").join(marks, "id", "left").na.fill(0, ["beside", *[f"mark_{k}" for k in range(MARKS)]])
    placed = scratch.written(placed.withColumns({"common": common, "m": F.lit(RARE).cast("long")}), "common")
    both = _common_at_most().alias("both")
    sizes = ["id_a", "id_b", "n_a", "n_b", "both"]
    # what both sides have of rare ones at most, so that a pair that is out of reach does not leave the join once for each rare shingle
    most = _common_at_most() + F.least(F.col("n_a") - F.col("common_a"), F.col("n_b") - F.col("common_b"))
    shared = _across(rare.where("df > 1").join(placed, "id"), "shingle", _in_reach(F.least("n_a", "n_b"), hundredths) & _in_reach(most, hundredths)).select("id_a", "id_b", "n_a", "n_b", both).groupBy(*sizes).agg(F.count("*").alias("shared"))
    shared = shared.where(_in_reach(F.col("both") + F.col("shared"), hundredths))
    alike = rows.select("bucket", "id", "m").join(placed.drop("m").where(100 * F.col("common") >= hundredths * F.col("n")), "id")
    # the cheap bound first: marks are compared only where it does not decide
    alike = _across(alike, "bucket", _in_reach(F.least("common_a", "common_b"), hundredths) & _in_reach(_common_at_most(), hundredths))
    return shared.select("id_a", "id_b", F.lit(RARE).cast("long")).union(alike.select("id_a", "id_b", "m_a")).toDF("a", "b", "m")


def _links(texts: DataFrame, reps: DataFrame, threshold: float, size: int, scratch: Scratch) -> DataFrame | None:
    """(id, component) of the classes that are linked with another one; None if there are none."""
    width, hundredths = 4 * ROWS, round(100 * threshold)
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * width + 1, width)) for k in range(BANDS)])
    rows = reps.select("id", "n", F.explode(bands).alias("bucket"))
    lead = F.min(F.struct("id", "n"))
    shared = scratch.written(rows.groupBy("bucket").agg(F.count("*").alias("m"), lead["id"].alias("lead"), lead["n"].alias("lead_n")).where("m > 1"), "buckets")
    buckets = scratch.written(rows.join(shared, "bucket"), "banded")
    if is_empty(buckets):
        return None
    involved = buckets.select("id").distinct()
    sets = scratch.written(
        texts.join(involved.hint("merge"), texts[ROW] == involved["id"]).select("id", "text").mapInArrow(_sets(size), "id long, value binary"), "sets"
    ).join(reps.select("id", "n"), "id")
    signatures = reps.join(involved, "id").select("id", "n", F.col("sig").alias("value"))

    def verify(pairs: DataFrame) -> DataFrame:
        probable = scratch.written(_beside(pairs, signatures).mapInArrow(_probable(threshold), f"{PAIR}, chunk long"), "probable")
        return scratch.written(_beside(probable, sets.select("id", "n", "value")).mapInArrow(_verified(threshold), PAIR), "links")

    # First, each bucket's members against its least id and against their neighbours by size, in parts of about PART members.
    # The number of parts is a power of two, so that buckets of like size part their members alike and the same neighbours meet in all of them.
    part = F.pmod(F.xxhash64("id"), F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.lit(1), F.col("m") / PART)))).cast("int"))
    beside = Window.partitionBy("bucket", part).orderBy("n", "id")
    one = F.lit(1).cast("long").alias("m")
    near = buckets.select(F.lag("id").over(beside).alias("a"), F.col("id").alias("b"), F.lag("n").over(beside).alias("n_a"), "n", one)
    near = near.where(F.col("a").isNotNull() & _sizes_fit("n_a", "n", hundredths)).select("a", "b", "m")
    star = buckets.where((F.col("id") != F.col("lead")) & _sizes_fit("lead_n", "n", hundredths)).select(F.col("lead").alias("a"), F.col("id").alias("b"), "m")
    tried = scratch.written(_chunked(star.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m")), "tried")
    links = verify(tried)
    # Then, in buckets that still hold several components, the pairs across components.
    labels = scratch.written(component_labels(links), "labels")
    placed = buckets.join(labels, "id", "left").select("bucket", "m", "id", "n", F.coalesce("component", "id").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    undecided = scratch.written(placed.join(several, "bucket"), "undecided")
    small = undecided.where(F.col("m") <= SMALL).withColumn("common", F.col("n"))
    small = _across(small, "bucket", _sizes_fit("n_a", "n_b", hundredths)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("m_a").alias("m"))
    across = _chunked(small.union(_across_large(undecided.where(F.col("m") > SMALL), sets, hundredths, scratch))).join(tried, ["a", "b"], "left_anti")
    more = verify(scratch.written(across, "across"))
    return scratch.written(component_labels(links.union(more)), "labels")
