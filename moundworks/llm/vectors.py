"""Vectors of finite numbers as integers, and as matrices in batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floored(vectors: DataFrame, scale: float, offset: int = 0, most: int = 1 << 61, column: str = "embedding") -> tuple[DataFrame, Column]:
    """The rows whose vector has finite components only, and the vector as floor(scale * component) + offset.
    Where scale * component is beyond ``most`` it is held there, so that differences and sums stay longs."""
    v = F.col(column).cast("array<double>")
    finite = v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(most))), F.lit(-float(most)))) + F.lit(offset).cast("long"))
    return vectors.where(finite), x


def matrices(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of each length in a list column: length, their rows, and a row for each of them."""
    sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, flat.reshape(len(rows), size) if len(rows) == len(sizes) else flat[first[rows][:, None] + np.arange(size)]
