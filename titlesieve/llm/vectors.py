"""Vectors in columns and in batches, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 21  # components that a slice of a batch may hold


def finite(vector: Column) -> Column:
    """The vector is there, not empty, and has only finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def common_length(vectors: DataFrame) -> int:
    """The length of the finite vector of the smallest vec_id (null ids last, then the least vector); 0 without one."""
    first = vectors.filter(finite(F.col("embedding"))).orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    return first[0] if first else 0


def of_length(vectors: DataFrame, length: int) -> DataFrame:
    return vectors.filter((F.size("embedding") == length) & finite(F.col("embedding")))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists without nulls, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces whose vectors of ``length`` components stay below a fixed size."""
    rows = max(_CELLS // max(length, 1), 1)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
