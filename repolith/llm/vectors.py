"""Vectors from array columns, and streaming of units that hold vectors and queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str, nonzero: bool = False) -> Column:
    """Neither null nor empty, no null or non-finite component; with ``nonzero`` not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    ok = F.col(column).isNotNull() & ~F.coalesce(F.exists(F.col(column).cast("array<double>"), bad), F.lit(True))
    if nonzero:
        ok = ok & F.coalesce(F.exists(F.col(column).cast("array<double>"), lambda x: x != 0), F.lit(False))
    return ok


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(lengths.max(initial=0)), width or 0)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out
