"""Whole vectors as integers, for the operators that compute on them exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def whole(vectors: DataFrame, scale: int, most: float, vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """vec_id, label, v (array<long>, each component floor(scale * x)) of the rows whose vector is there and has no null or non-finite
    component, and whose squared length stays under ``most``, beyond which a long cannot hold what is computed from it."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(2.0**31), F.lit(False)))  # neither null, NaN nor beyond
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    there = vectors.where(F.col(vector).isNotNull()).where(finite)
    return there.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).alias("label"), scaled.alias("v")).where(square < most)


def matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column as int64, padded with zeros to ``width`` components."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
