"""Vectors as exact integers: floor(scale * x) of every component, x as a double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of products that stay below this are exact as doubles.
EXACT = 2.0**53


def finite(embedding: str) -> Column:
    """True for vectors that are not null and hold neither null nor non-finite components."""
    e = F.col(embedding)
    return F.coalesce(e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def by_length(column: pa.Array, scale: int):
    """(rows, matrix) for each length of a column's vectors (all fine): the integers, held as doubles. The scale is a
    power of two, so they are exact; components so large that their multiple is no double are an error."""
    size = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten()).astype(float)
    begin = np.cumsum(size) - size
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        x = np.floor(flat[(begin[rows][:, None] + np.arange(dim)).ravel()] * scale).reshape(len(rows), dim)
        if not np.isfinite(x).all():
            raise ValueError(f"a vector's component times {scale} is no double")
        yield rows, x


def whole(x: np.ndarray) -> np.ndarray:
    """Doubles that hold integers as Python's integers."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def exact_bits(*xs: np.ndarray) -> bool:
    """Whether all sums of products of the xs' rows, and their squared distances, are exact as doubles."""
    largest = max((float(np.abs(x).max()) for x in xs if x.size), default=0.0)
    return 4 * largest**2 * max(x.shape[-1] for x in xs) < EXACT if largest < 2.0**27 else False
