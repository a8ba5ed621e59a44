"""Vectors as whole numbers: what the vector operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024


def whole(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """`df` with `vector` as floor(scale * component), all floors going down.

    Rows whose vector is null or holds null or non-finite components are dropped; an empty
    vector is kept. A component whose product leaves the range of a long is an error.
    """
    limit = F.lit(float("inf"))
    usable = F.forall(vector, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < limit), F.lit(False)))
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return df.filter(F.col(vector).isNotNull() & usable).withColumn(vector, numbers)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of `width` columns; shorter vectors end in zeros."""
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, place] = flat
    return out


def padded(vectors: Sequence[Sequence[int]], width: int) -> np.ndarray:
    """The same for vectors on the driver."""
    return np.array([[*v, *[0] * (width - len(v))] for v in vectors], np.int64).reshape(len(vectors), width)


def fits(most: int, terms: int) -> None:
    """Raise where a sum of `terms` products of numbers up to `most` may leave the range of a long."""
    if most * most * max(terms, 1) >= 1 << 63:
        raise OverflowError(f"products of components up to {most} do not fit a long")


def greatest(vector: str) -> Column:
    """The greatest absolute component of the vector."""
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x)))
