"""Vectors of integers from tables of embeddings, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the integer grid in one unit.
SCALE = 256


def _each(vector: Column, test) -> Column:
    """Whether a vector is there and all its components, none null, pass a test on doubles."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & test(x.cast("double")))


def limit(size: int, spare: int = 0) -> float:
    """Components below it, scaled, have products whose sum over size of them fits 64 bits, with so many bits to spare."""
    return 2.0 ** ((62 - spare - (size - 1).bit_length()) // 2) / SCALE


def usable(vectors: DataFrame, parts: int = 1, spare: int = 0, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vectors can be compared, and the length of their vectors.

    Null vectors and those with a null, NaN or infinite component go.  The length is that of the smallest vec_id's vector
    among those whose length is a positive multiple of parts; rows of another length go, and those with a component of
    limit() and more (at 64 components: 2^20, with two bits to spare 2^19).  Without rows: 0."""
    v = F.col(column)
    kept = vectors.filter(_each(v, lambda x: F.abs(x) < float("inf")) & (F.size(v) > 0) & (F.size(v) % parts == 0))
    first = kept.select("vec_id", F.size(v).alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").first()
    if not first:
        return kept, 0
    most = limit(first.n, spare)
    return kept.filter((F.size(v) == first.n) & _each(v, lambda x: F.abs(x) < most)), first.n


def scaled(column: str = "embedding") -> Column:
    """Components as floor(SCALE * x), as doubles."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(SCALE * x) from an Arrow array of lists of one size, without nulls."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, size)
