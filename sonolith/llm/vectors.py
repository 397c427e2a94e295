"""Vectors as rows: which ones take part, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numeric(vector: Column) -> Column:
    return vector.cast("array<double>")


def complete(vector: Column) -> Column:
    """Not null, not empty, and no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("vec_id"), numeric(F.col(vector_col)).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None, kind=np.float64) -> np.ndarray:
    """Lists of equal length as a matrix of doubles, or of another type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, width or 0)
