"""Whitening of embeddings on the principal axes of their exact integer form.

Each component becomes a whole number, so sums are exact and rows are centred without rounding before anything is multiplied. MLlib's
``RowMatrix`` sums the outer products of the centred rows; what comes to the driver is one matrix of d * d numbers, whatever the rows. Its
eigenvectors are broadcast (d numbers for each component asked for) and applied in ``mapInPandas``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._spark import Scratch, written
from storyloom.llm._vectors import finite, matrix, usual_length

#: Whole numbers stay within this, where doubles are exact; larger components count as this one.
LARGEST = 2.0**52
#: Directions whose variance is a smaller share of the whole than this have none that doubles could tell from rounding.
NOTHING = 1e-14
WHITENED = "vec_id long, n long, deviation long, whitened array<double>"


@dataclass(frozen=True)
class Whitening:
    """What is fitted: n rows with the sums ``sums`` of each dimension, and the leading eigenvalues and unit eigenvectors (columns) of their covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """(vec_id, x): the vectors that take part, each component c as the long floor(scale * c) + offset.

    Null vectors, empty ones and those with null or non-finite components are left out, and so are vectors of another length than most have.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(finite("v"))
    near = F.transform("v", lambda c: (F.floor(F.greatest(F.least(scale * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))) + offset).cast("long"))
    return rows.where(F.size("v") == usual_length(rows, "v")).select("vec_id", near.alias("x"))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("x"), np.int64)
            # halves of 26 bits, so that no sum of a batch leaves a long
            part = [int(h) * (1 << 26) + int(r) for h, r in zip((x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0))]
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part)]
    if n:
        values = pa.array([Decimal(n), *map(Decimal, sums)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), values], ["dim", "value"])


def exact_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """The number of rows (vec_id, x) and the sum of each dimension; a task sends one number for each dimension."""
    found = rows.select("x").mapInArrow(_partial_sums, "dim int, value decimal(38,0)").groupBy("dim").agg(F.sum("value").alias("value")).orderBy("dim").collect()
    return (int(found[0]["value"]), tuple(int(r["value"]) for r in found[1:])) if found else (0, ())


def _gramian(rows: DataFrame, column: str, n: int, d: int) -> np.ndarray:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("row")), "row")
    return RowMatrix(vectors, n, d).computeGramianMatrix().toArray()


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Fits on all ``rows`` (vec_id, x); None without any row.

    A centred component is x - S/n. Its whole part is subtracted as a long and its fraction is below 1, so it is right to the last place.
    """
    n, sums = exact_sums(rows)
    if not n:
        return None
    whole, rest = F.array(*[F.lit(s // n).cast("long") for s in sums]), F.array(*[F.lit(s % n / n) for s in sums])
    centred = rows.select(F.transform("x", lambda c, k: (c - F.get(whole, k)).cast("double") - F.get(rest, k)).alias("row"))
    covariance = _gramian(centred, "row", n, len(sums)) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[: min(components, len(sums))]
    vectors = vectors[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return Whitening(n, sums, np.maximum(values[order], 0.0), vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(covariance)))


def _deviations(near: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """The exact sums of (n * x - S) ** 2, given x - S // n and S % n; null where a long does not hold one."""
    if (float(np.abs(near).max(initial=0)) + 1) ** 2 * float(n) ** 2 * max(1, near.shape[1]) < 2.0**62:
        return ((near * n - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    found = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in near]
    return [x if x < 1 << 63 else None for x in found]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, n, deviation, whitened) of each of ``rows`` (vec_id, x).

    ``deviation`` is the sum over dimensions of (n * x - S) ** 2, exact, and null where a long does not hold it. ``whitened`` has one number for each
    component, null for components without variance.
    """
    spread = model.values > NOTHING * model.trace
    weights = np.where(spread, model.vectors / np.sqrt(np.where(spread, model.values, 1.0)), np.nan)
    shared = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, weights))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, weights = shared.value
        whole, rest = np.array([s // n for s in sums], np.int64), [s % n for s in sums]
        fraction = np.array([r / n for r in rest])
        for frame in frames:
            if len(frame):
                near = np.stack(frame["x"].to_numpy()).astype(np.int64) - whole
                out = (near.astype(float) - fraction) @ weights
                deviation = pd.array(_deviations(near, rest, n), dtype="Int64")
                cells = list(out) if not np.isnan(out).any() else [[None if np.isnan(c) else c for c in r] for r in out]
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "n": n, "deviation": deviation, "whitened": cells})

    return rows.mapInPandas(run, WHITENED)


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over components with variance; null without any."""
    spread = [k for k, v in enumerate(model.values) if v > NOTHING * model.trace]
    if not spread:
        return None
    # a column of ones beside them gives the sums
    cells = F.array(*[F.get("whitened", F.lit(k)) for k in spread], F.lit(1.0)).alias("row")
    gramian = _gramian(whitened.select(cells), "row", model.n, len(spread) + 1) / model.n
    mean = gramian[-1, :-1]
    return float(np.abs(gramian[:-1, :-1] - np.outer(mean, mean) - np.eye(len(spread))).max())


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector that takes part and each component.

    Components are numbered from 1 by falling variance; the entry of largest size of each is positive. ``explained`` is a component's share of the
    variance, null if there is none at all; ``whitened`` is null for a component without variance (one row, equal rows, dimensions that depend on
    others). Rows that repeat a vec_id count and are returned one by one; a null vec_id stays null; an empty table yields no rows.
    """
    scratch = Scratch()
    rows = scratch.written(whole_numbers(df, vec_id, vector), "whole-numbers")
    model = fit(rows, components)
    if model is None:
        nothing = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], nothing)
    found = written(apply(rows, model), "whitened")
    scratch.close()
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values])
    one = found.select("vec_id", F.posexplode("whitened").alias("k", "whitened"), "n", "deviation")
    return one.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(identity_error(found, model)).cast("double").alias("identity_error"))
