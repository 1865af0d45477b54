"""Vector arithmetic over Arrow batches. Vectors are stored as float, all arithmetic is in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-12
# Scores are compared and ordered at this many decimals, so that rounding noise of a matrix product never decides
# between rows whose vectors are equal; the row index does.
RANK_DECIMALS = 9


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a two-dimensional double array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    return flat.reshape(len(vectors), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length; a zero row stays zero."""
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + EPSILON)


def cosine_to(vectors: Column, query: list[float]) -> Column:
    """Cosine of every vector with one fixed query vector."""
    direction = unit_rows(np.asarray([query], dtype=np.float64))[0]

    @F.arrow_udf(T.DoubleType())
    def score(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.float64())
        return pa.array(unit_rows(matrix(batch)) @ direction)

    return score(vectors)


def ranked(cosines: Column) -> Column:
    """Scores as they are compared and ordered."""
    return F.round(cosines, RANK_DECIMALS)


def project_to(vectors: Column, axes: np.ndarray) -> Column:
    """Coordinates of every unit vector along the columns of ``axes``, as an array."""
    axes = np.asarray(axes, dtype=np.float64)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def coordinates(batch: pa.Array) -> pa.Array:
        if len(batch) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return pa.array(list(unit_rows(matrix(batch)) @ axes), pa.list_(pa.float64()))

    return coordinates(vectors)


def vector_key(vectors: Column) -> Column:
    """A 128-bit name for a vector: equal vectors get equal names."""
    return F.concat_ws("-", F.hex(F.xxhash64(vectors)), F.hex(F.xxhash64(F.lit("second"), vectors)))
