"""What the operators on vectors share: which rows take part, and vectors as arrays of numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    inside = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(inside, F.lit(False))


def usual_length(rows: DataFrame, vector: str) -> int:
    """The length that most vectors have, the longer one of equally frequent ones; -1, which none has, if no vector has a component."""
    lengths = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    return lengths.agg(F.max_by("d", F.struct("n", "d"))).first()[0] or -1


def matrix(column: pa.Array | pa.ChunkedArray, dtype=None) -> np.ndarray:
    """The vectors of a list column, all of one length, as the rows of a matrix."""
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    flat = chunks[0] if len(chunks) == 1 else np.concatenate(chunks) if chunks else np.zeros(0)
    return flat.reshape(len(column), -1 if len(column) else 0).astype(dtype or flat.dtype, copy=False)


def list_column(rows: np.ndarray) -> pa.ListArray:
    """A matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))
