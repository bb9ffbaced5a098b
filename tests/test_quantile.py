"""The exact quantile against numpy, also where rows are narrowed first."""

import numpy as np
import pytest

from latticeworks.operators import grid


@pytest.mark.parametrize("values", [np.random.default_rng(1).normal(size=5000), np.repeat([1.0, 2.0, 7.0], [900, 50, 50]), np.repeat([3.0], 1000), np.r_[np.zeros(2000), np.random.default_rng(2).random(500)], np.array([4.0]), np.array([1.0, 2.0])])
@pytest.mark.parametrize("quantile", [0.95, 0.5, 0.0, 1.0])
def test_exact_quantile(spark, monkeypatch, values, quantile):
    monkeypatch.setattr(grid, "QUANTILE_ROWS", 60)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "d double")
    assert grid.exact_quantile(rows, "d", quantile).first()[0] == pytest.approx(float(np.quantile(values, quantile)), abs=1e-12)


def test_no_values(spark):
    assert grid.exact_quantile(spark.createDataFrame([], "d double"), "d", 0.5).first()[0] is None
