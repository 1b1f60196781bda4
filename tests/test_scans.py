"""Running sums over several levels of blocks."""

import numpy as np
import pytest
from latticeframe.operators import lanes
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.tensor import Tensor


@pytest.mark.parametrize("block", [2, 4, 7])
def test_levels(spark, monkeypatch, block):
    monkeypatch.setattr(lanes, "BLOCK", block)
    x = np.random.default_rng(block).normal(size=61)
    t = Tensor(fromarray(spark, x).df.repartition(4), 1)
    np.testing.assert_allclose(toarray(lanes.cumsum(t)), np.cumsum(x), atol=1e-12)
    np.testing.assert_allclose(toarray(lanes.cumprod(t)), np.cumprod(x), atol=1e-12)
    y = np.cumsum(x * 3) % 6.28
    np.testing.assert_allclose(toarray(lanes.unwrap(fromarray(spark, y), 6.28)), np.unwrap(y, period=6.28), atol=1e-9)
    m = x[:60].reshape(3, 20)
    np.testing.assert_allclose(toarray(lanes.cumsum(fromarray(spark, m), 1)), np.cumsum(m, 1), atol=1e-12)
    np.testing.assert_allclose(toarray(lanes.cumsum(fromarray(spark, m))).ravel(), np.cumsum(m), atol=1e-12)


def test_lanes_of_unequal_lengths_and_gaps(spark, monkeypatch):
    """A block without cells, and keys that end early."""
    monkeypatch.setattr(lanes, "BLOCK", 3)
    cells = [("a", i) for i in (0, 1, 9, 10, 30)] + [("b", 2)] + [(None, i) for i in range(29)]
    t = Tensor(spark.createDataFrame([(k, i, float(i + 1)) for k, i in cells], "key string, i0 long, v double"), 1, ("key",))
    got = {(r.key, r.i0): r.v for r in lanes.cumsum(t).df.collect()}
    assert got == {(k, i): sum(j + 1.0 for q, j in cells if q == k and j <= i) for k, i in cells}


def test_every_window_is_partitioned(spark, monkeypatch):
    monkeypatch.setattr(lanes, "BLOCK", 5)
    plan = lanes.cumsum(Tensor(fromarray(spark, np.arange(200.0)).df, 1)).df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4 and all("windowspecdefinition(_b" in w for w in windows)
