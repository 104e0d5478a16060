"""Rows of vectors that are taken as they come: of any length, repeated or not."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_rows(embeddings: DataFrame, *also: str) -> DataFrame:
    """vec_id, the vector as doubles and other columns as longs, of rows whose vector is neither null nor holds nulls or
    non-finite entries."""
    e = embeddings.select(*[F.col(c).cast("long").alias(c) for c in ("vec_id", *also)], F.col("embedding").cast("array<double>").alias("embedding"))
    return e.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def filled(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """rows x width integers; shorter rows end in the fill value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy()).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.full((len(n), width), fill, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out
