"""Vector columns as blocks of numbers inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """The vector is not null and holds neither nulls nor non-finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows whose vector is finite, as doubles."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter(finite(F.col("v")))


def block(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers each, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as lists."""
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))
