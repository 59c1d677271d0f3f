"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, every component present and finite, at least one not zero."""
    number = lambda x: x.cast("double")
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & ok & F.exists(vector, lambda x: x.isNotNull() & (x != 0)), F.lit(False))


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow, no vanishing squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def prepared(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
