"""Transforms of lanes that no task holds whole, of any length."""

import numpy as np
import pandas as pd
import pytest
from latticeframe.operators import fourier
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.tensor import Tensor

COSINES = ("dctone", "dcttwo", "dstone", "dsttwo")


@pytest.mark.parametrize("name", COSINES)
@pytest.mark.parametrize("n", [17, 20, 32, 33])
def test_cosines(spark, monkeypatch, name, n):
    monkeypatch.setattr(fourier, "LONG", 8)
    x = np.random.default_rng(n).normal(size=(n, 2))
    got = toarray(getattr(fourier, f"{name}1d")(fromarray(spark, x), 0))
    np.testing.assert_allclose(got, fourier._kernel(name, n) @ x, atol=1e-10)


@pytest.mark.parametrize("sign", [-1, 1])
def test_transforms_of_any_length(spark, sign):
    x = np.random.default_rng(1).normal(size=45) + 1j
    got = toarray(fourier._of_any_length(fromarray(spark, x), 45, 0, sign))
    np.testing.assert_allclose(got, np.fft.fft(x) if sign < 0 else np.fft.ifft(x) * 45, atol=1e-10)


def test_analytic_signals(spark, monkeypatch):
    monkeypatch.setattr(fourier, "LONG", 8)
    x = np.random.default_rng(2).normal(size=(12, 22))
    t = fromarray(spark, x)
    want = fourier._analytic(x)
    np.testing.assert_allclose(toarray(fourier.hilbert1d(t, 1)), want, atol=1e-10)
    np.testing.assert_allclose(toarray(fourier.hilbert1dr(t, 1)), want.imag, atol=1e-10)
    both = fourier._analytic(want.T, 16).T
    np.testing.assert_allclose(toarray(fourier.hilbert2(t, 16)), both, atol=1e-10)
    with pytest.raises(ValueError, match="odd"):
        fourier.hilbert1d(fromarray(spark, np.ones(9)))


def test_a_lane_of_many_cells(spark):
    """More cells than a task takes, of an odd length; some bins by their sums."""
    n = 2**16 + 3
    x = np.random.default_rng(3).normal(size=n)
    t = Tensor(spark.createDataFrame(pd.DataFrame({"i0": np.arange(n), "v": x})), 1, (), (n,))
    found = fourier.dcttwo1d(t).df.toPandas().set_index("i0").v
    assert len(found) == n
    for k in (0, 1, 777, n // 2, n - 1):
        np.testing.assert_allclose(found[k], 2 * (x * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))).sum(), atol=1e-6)
