"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be compared: not null or empty, not zero, no null or non-finite component, and of the most frequent length
    (the shorter of equals)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    good = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & ~zero)
    size = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.filter(F.size(vector) == (size["d"] if size else 0))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of equal lengths as rows."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    """Runs of flat values as lists; ends: where each run stops."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))
