"""Vector columns as NumPy matrices, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^62: integers below it fit a long, and so do the differences of two
LONG = float(2 ** 62)


def finite(col: str) -> Column:
    """True if no component is null, NaN or infinite (false for a null vector)."""
    return F.coalesce(F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(col: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold exactly `dim` finite components, and floor(scale * x) of these rows' as longs. Rows
    with a component that fits no long are left out too."""
    sizes = pa.compute.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == dim)
    flat = pa.compute.list_flatten(col.take(pa.array(right))).cast(pa.float64()).fill_null(np.nan)
    with np.errstate(over="ignore"):
        x = np.floor(scale * flat.to_numpy(zero_copy_only=False)).reshape(len(right), dim)
    good = (np.abs(x) < LONG).all(1) if dim else np.zeros(len(right), bool)
    return right[good], x[good].astype(np.int64)


def widest(x: np.ndarray) -> int:
    """Largest absolute value, 0 of nothing."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def commonest_length(df: DataFrame, col: str) -> int:
    """The length that most finite, non-empty vectors have (the larger of equals); 0 if there is none."""
    top = df.filter(finite(col) & (F.size(col) > 0)).groupBy(F.size(col).alias("d")).count() \
        .orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0
