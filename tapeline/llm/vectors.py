"""Vector columns of Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """Components of each vector; -1 for null ones and those that hold null or non-finite components."""
    n = np.asarray(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False), np.int64)
    parts = column.flatten().cast(pa.float64())
    bad = pc.fill_null(pc.invert(pc.is_finite(parts)), True).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), np.maximum(n, 0))
    n[row[bad]] = -1
    return n


def matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, all valid and of one length, in double precision."""
    taken = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return taken.reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
