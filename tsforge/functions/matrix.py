"""Features computed on whole matrices of windows: one row per window, one column per step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from tsforge.functions.vectors import ExtraFeature

# Takes a float64 matrix (windows x steps) and returns one of the same shape. Each row of the result may depend on the
# same row only, for how windows are dealt to matrices is left to Spark.
MatrixFunction = Callable[[np.ndarray], np.ndarray]

#: Values of one matrix: a plug-in never gets more than this, or one longer window, at once.
MATRIX_VALUES = 1 << 20


def apply_to_windows(
    windows: pa.ListArray, function: MatrixFunction, steps: int | None = None, values: int = MATRIX_VALUES
) -> pa.ListArray:
    """The function's result for each window, matrix by matrix.

    A NULL window stays NULL. NULL elements are NaN in the matrix, and NaN results are NULL elements. Windows of unequal
    lengths, or of other lengths than `steps`, and a result of another shape are errors.
    """
    whole = windows.is_valid().to_numpy(zero_copy_only=False)
    present = windows.filter(pa.array(whole))
    if not len(present):
        return pa.nulls(len(windows), pa.list_(pa.float64()))
    lengths = present.value_lengths().to_numpy()
    width = int(lengths[0]) if steps is None else steps
    if (lengths != width).any():
        raise ValueError(f"windows of {width} steps are expected, one has {lengths[lengths != width][0]}")
    flat = present.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    matrix = flat.reshape(len(present), width)
    size = max(1, values // max(1, width))
    results = []
    for begin in range(0, len(matrix), size):
        part = matrix[begin : begin + size].copy()
        result = np.asarray(function(part), np.float64)
        if result.shape != part.shape:
            raise ValueError(f"the feature made {result.shape} of {part.shape}")
        results.append(result)
    elements = pa.array(np.concatenate(results).reshape(-1), from_pandas=True)
    offsets = np.concatenate(([0], np.cumsum(np.where(whole, width, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), elements, mask=pa.array(~whole))


def matrix_feature(function: MatrixFunction, values: int = MATRIX_VALUES) -> ExtraFeature:
    """An extra feature, as the plans take it, from a function of matrices.

    Windows travel to Python as Arrow batches, whose rows `spark.sql.execution.arrow.maxRecordsPerBatch` bounds.
    """

    def feature(window: Column, steps: int | None = None) -> Column:
        def run(windows: pa.Array) -> pa.Array:
            return apply_to_windows(windows, function, steps, values)

        return arrow_udf(run, "array<double>")(window)

    return feature


def step_changes(matrix: np.ndarray) -> np.ndarray:
    """Change from the previous step; 0 at the first."""
    return np.diff(matrix, axis=1, prepend=matrix[:, :1])
