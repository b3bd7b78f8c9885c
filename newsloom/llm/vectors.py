"""Vectors of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column without nulls as float64, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def floors(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor x), exact: int64 where that is safe, else Python integers."""
    if np.abs(x).max(initial=0) * factor < 2.0**52:
        return np.floor(x * factor).astype(np.int64)
    # Floats of this size are integers; a power of two keeps the others exact.
    exact = [int(v) * factor if abs(v) >= 2.0**52 else int(np.floor(v * factor)) for v in x.ravel().tolist()]
    out = np.empty(x.size, dtype=object)
    out[:] = exact
    return out.reshape(x.shape)
