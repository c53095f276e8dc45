"""Vectors as rows: which take part, and numpy matrices from Arrow columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors of finite components, one of them not zero; false for null and empty ones."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_row_each(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each not null ``vec_id``: of several the smallest, by the given columns."""
    rows = df.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*columns)).alias("_r"))
    return rows.select("vec_id", *(F.col(f"_r.{c}").alias(c) for c in columns))


def matrix(column) -> np.ndarray:
    """A pandas column of equally long lists as a double matrix."""
    return np.array(column.to_list(), dtype=np.float64).reshape(len(column), -1)


def dot_in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, added component after component."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total
