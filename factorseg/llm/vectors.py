"""Checks and Arrow access for columns of float arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(column: str) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def of_usual_size(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The usable rows whose array has the most frequent length (the longer, if several), and that length (0: no rows)."""
    good = df.filter(usable(column))
    top = good.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    size = top["d"] if top else 0
    return good.filter(F.size(column) == size), size


def matrix(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, each summed in the same order wherever the rows lie."""
    return (a * b).sum(axis=1)
