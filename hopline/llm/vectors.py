"""Vector columns as numpy matrices, and which rows of a table of vectors can be used."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether the vector and all its entries are there and finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < math.inf, F.lit(False)))
    return F.coalesce(F.col(vector).isNotNull() & sound, F.lit(False))


def within(vector: str, bound: float) -> Column:
    """Whether no entry of a finite vector is beyond the bound."""
    return F.forall(vector, lambda c: F.abs(c.cast("double")) <= bound)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of vectors of one length, without nulls, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))
