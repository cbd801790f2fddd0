"""Integer vectors from a column of embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer steps in one unit of a component.
STEPS = 256
#: Largest integer component: squared distances and inner products of 512 of them still fit a long.
BOUND = 1 << 26
#: Components that a worker turns into arrays at once.
CELLS = 1 << 20


def usable(vector: str = "embedding") -> Column:
    """Rows whose vector is there and holds neither null nor non-finite components."""
    faulty = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~faulty


def width(rows: DataFrame, vector: str = "embedding") -> int:
    """Components of the longest vector; 0 without rows."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def integers(column: pa.Array, width: int) -> np.ndarray:
    """``floor(256 * x)`` of every component, a row a vector; shorter vectors are filled up with zeros."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    if len(x) and np.abs(x).max() > BOUND:
        raise ValueError(f"embedding components beyond {BOUND // STEPS:,} cannot be scored in 64-bit integers")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return x.astype(np.int64).reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than ``CELLS`` components (one row at least)."""
    rows = max(1, CELLS // max(1, width))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
