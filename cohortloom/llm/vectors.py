"""Vector columns as whole numbers: floor(256 * c) of every component, for the operators on `embeddings`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps per unit of a component.
STEPS = 256


def usable(vector: str) -> Column:
    """Whether the vector is there and every entry of it is a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def whole(vector: str) -> Column:
    """array<bigint> of floor(256 * c), c as double."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * STEPS).cast("long"))


def whole_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows with a usable, non-empty vector."""
    return df.where(usable(vector) & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("key"), whole(vector).alias("x"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<int64> column as an int64 matrix; every list has `width` values."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
