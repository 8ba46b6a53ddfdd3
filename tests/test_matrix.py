"""Features of whole matrices: shapes, missing values, bounded matrices, the plan with such a feature."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_windows import CONFIG, minute_bars, shift_lookup
from tsforge.functions.matrix import apply_to_windows, matrix_feature, step_changes
from tsforge.functions.vectors import one_step_change
from tsforge.plans.candle_features import prepare


def test_missing_values_and_windows():
    windows = pa.array([[1.0, 2.0, 4.0], None, [3.0, None, 5.0], [0.0, 0.0, 0.0]], pa.list_(pa.float64()))
    for part in (windows, windows.slice(1), windows.slice(1, 1), windows.slice(0, 0)):
        got = apply_to_windows(part, lambda m: 2 * m).to_pylist()
        assert got == [w and [x if x is None else 2 * x for x in w] for w in part.to_pylist()]
    assert apply_to_windows(windows.slice(2, 1), step_changes).to_pylist() == [[0.0, None, None]]


def test_the_input_is_not_changed():
    windows = pa.array([[1.0, 2.0]])

    def spoil(matrix):
        matrix[:] = 7
        return matrix

    assert apply_to_windows(windows, spoil).to_pylist() == [[7.0, 7.0]]
    assert windows.to_pylist() == [[1.0, 2.0]]


@pytest.mark.parametrize("values, most", [(1, 1), (12, 3), (1 << 20, 100)])
def test_matrices_are_bounded(values, most):
    rows = np.random.default_rng(3).normal(size=(100, 4))
    seen = []

    def record(matrix):
        seen.append(len(matrix))
        return np.cumsum(matrix, axis=1)

    got = apply_to_windows(pa.array(list(rows)), record, 4, values)
    assert np.allclose(got.to_pylist(), np.cumsum(rows, axis=1))
    assert max(seen) == most and sum(seen) == 100


def test_other_shapes_are_errors():
    same = pa.array([[1.0, 2.0]])
    with pytest.raises(ValueError, match="3 steps are expected, one has 2"):
        apply_to_windows(same, step_changes, 3)
    with pytest.raises(ValueError, match="2 steps are expected, one has 1"):
        apply_to_windows(pa.array([[1.0, 2.0], [1.0]]), step_changes)
    with pytest.raises(ValueError, match="made"):
        apply_to_windows(same, lambda m: m[:, 1:])


def test_plan_with_a_matrix_feature_equals_the_built_in_one(spark):
    bars, lookup = minute_bars(spark), shift_lookup(spark)
    one, other = (
        {(r.instrument, r.session_date, r.sample_slot): r for r in prepare(bars, lookup, CONFIG, extra).samples.collect()}
        for extra in (one_step_change, matrix_feature(step_changes))
    )
    assert one.keys() == other.keys() and one
    for key, row in one.items():
        a, b = (np.array([list(step) for step in x.tensor], dtype=float) for x in (row, other[key]))
        assert np.allclose(a, b, atol=1e-12, equal_nan=True)
    wide = matrix_feature(lambda m: np.sort(m, axis=1))
    rows = prepare(bars, lookup, CONFIG, wide).samples.select(F.size("tensor").alias("n")).distinct().collect()
    assert [r.n for r in rows] == [CONFIG.n_back]


def test_windows_go_to_python_once(spark):
    bars, lookup = minute_bars(spark), shift_lookup(spark)
    samples = prepare(bars, lookup, CONFIG, matrix_feature(step_changes)).samples
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
