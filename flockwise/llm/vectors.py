"""Integer vectors, which the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import offsets_of


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine, F.lit(False))


def floored(vector: str, factor: float) -> Column:
    """floor(factor * x) of every component, with x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def longest(df: DataFrame, vector: str) -> int:
    """The greatest number of components; shorter vectors count as filled up with zeros."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list array as integer rows of ``width`` components, filled up with zeros."""
    at = offsets_of(lists)
    values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(lists) else np.zeros(0, np.int64)
    sizes = np.diff(at)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out
