"""Vectors of whole numbers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each component becomes floor(SCALE * x).
SCALE = 256
#: Larger components are an error: within it sums of squares stay exact in 64 bits up to 2^18 components.
LIMIT = 1 << 21


def finite(vector: Column) -> Column:
    """Whether there is a vector and none of its components is null, infinite or not a number."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """The components times ``scale``, rounded down; each is taken as a double first."""

    def one(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(y) <= LIMIT, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} in whole numbers")).cast("int"))

    return F.transform(vector, one)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of ``a`` with those of ``b``; in doubles where these hold them exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared distance of each row of ``a`` from ``b`` (one vector, or as many rows)."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)
