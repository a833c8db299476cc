"""Vectors between arrays of Spark and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fine(col: str) -> Column:
    """Whether a vector is not null, not zero and without null or non-finite components."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def kind_of(df: DataFrame, col: str) -> str:
    """numpy's name of the component type as bytes hold it."""
    return "<f4" if isinstance(df.schema[col].dataType.elementType, T.FloatType) else "<f8"


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_dimension(column: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each dimension of a column of lists."""
    dims = column.value_lengths().to_numpy()
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        yield rows, matrix(column.take(pa.array(rows)) if len(rows) < len(column) else column, kind)


def stacked(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)
