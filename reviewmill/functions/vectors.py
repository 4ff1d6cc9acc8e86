"""Cosine and distance columns over dense float arrays.

``cosine`` compares two columns inside the JVM. The functions that compare a column with a small
matrix known on the driver go through Arrow batches, so one BLAS call serves thousands of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from reviewmill.constants import NORM_EPSILON


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a)) + F.lit(NORM_EPSILON)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit_rows(matrix) -> np.ndarray:
    matrix = np.asarray(matrix, dtype=np.float64)
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + NORM_EPSILON)


def cosine_to_all(vectors: Column, matrix) -> Column:
    """array<double>: cosine of each vector with every row of a small matrix, in row order."""
    reference = unit_rows(matrix)
    epsilon = NORM_EPSILON

    def compare(column: pa.Array) -> pa.Array:
        width = reference.shape[0]
        present = np.asarray(column.is_valid())
        x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, reference.shape[1])
        if len(x) != present.sum():
            raise ValueError("vectors differ in width from the reference matrix")
        x /= np.linalg.norm(x, axis=1, keepdims=True) + epsilon
        offsets = np.concatenate([[0], np.cumsum(present * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            offsets, pa.array((x @ reference.T).ravel()), mask=pa.array(~present)
        )

    return F.arrow_udf(compare, "array<double>")(vectors)
