"""Checks and conversions that the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding"):
    """True for vectors that are not null, hold neither nulls nor non-finite components, and are not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(column, fine) & F.exists(column, lambda x: x != 0), F.lit(False))


def prepared(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>), usable; other columns are dropped."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    return v.withColumn("usable", usable("vector"))


def matrix(lists) -> np.ndarray:
    """Rows of a list column of equal lengths; each is scaled by a power of two, so that squares neither overflow nor vanish."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = len(lists)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    return np.ldexp(x, -exponent[:, None])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision; the same for a pair wherever its rows stand."""
    return np.einsum("ij,ij->i", x, y) / (lengths(x) * lengths(y))
