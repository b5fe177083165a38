"""Parts of Arrow batches, so that the memory of a task follows bytes and not rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` in which ``column`` has about ``most`` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(group)]):
        yield batch.slice(start, stop - start)
