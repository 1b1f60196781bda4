"""Moving medians and boxes against NumPy, for narrow and wide windows, in small blocks and tiles."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticeframe.operators import lanes, medians
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.operators.medians import Ranks, box_medians
from latticeframe.operators.polynomials import aberth, all_roots
from latticeframe.tensor import Tensor


def moving(x, width):
    left, right = width // 2, width - width // 2 - 1
    return np.array([np.median(x[max(0, i - left) : i + right + 1]) for i in range(len(x))])


def padded(x, width):
    p = np.concatenate([np.zeros(width // 2), x, np.zeros(width // 2)])
    return np.array([np.sort(p[i : i + width])[width // 2] for i in range(len(x))])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=60), st.data())
def test_kth_smallest(values, data):
    x = np.array(values, float)
    a = data.draw(st.integers(0, len(x) - 1))
    b = data.draw(st.integers(a + 1, len(x)))
    got = Ranks(x).kth(np.full(b - a, a), np.full(b - a, b), np.arange(b - a))
    assert got.tolist() == sorted(x[a:b].tolist())


@pytest.mark.parametrize("block", [5, 16, 65_536])
@pytest.mark.parametrize("width", [1, 2, 5, 8, 33, 1001])
def test_lanes(spark, monkeypatch, width, block):
    monkeypatch.setattr(lanes, "BLOCK", block)
    rng = np.random.default_rng(width)
    arrays = {k: np.round(rng.normal(size=n), 1) for k, n in (("a", 70), ("b", 1), (None, 23))}
    arrays["a"][[3, 40]] = np.nan
    t = Tensor(spark.createDataFrame([(k, i, float(v)) for k, x in arrays.items() for i, v in enumerate(x)], "key string, i0 long, v double").repartition(3), 1, ("key",))
    tests = [(lanes.movmedian, moving)] + ([(lanes.medfilt1d, padded)] if width % 2 else [])
    for f, want in tests:
        got = {(r.key, r.i0): r.v for r in f(t, width).df.collect()}
        assert len(got) == 94
        for k, x in arrays.items():
            np.testing.assert_array_equal([got[k, i] for i in range(len(x))], want(x, width))


def test_cost_does_not_follow_the_width():
    """Counted in passes over the cells: one for each bit of the ranks."""
    x = np.random.default_rng(1).normal(size=5000)
    for width in (5, 1001):
        start, stop = np.maximum(np.arange(5000) - width // 2, 0), np.minimum(np.arange(5000) + width // 2 + 1, 5000)
        np.testing.assert_array_equal(medians.window_medians(x, start, stop), moving(x, width))
    assert len(Ranks(x).levels) == 13


def boxed(x, widths):
    p = np.pad(x, [(w // 2, w // 2) for w in widths])
    seen = np.lib.stride_tricks.sliding_window_view(p, widths).reshape(*x.shape, -1)
    return np.sort(seen, axis=-1)[..., seen.shape[-1] // 2]


@pytest.mark.parametrize(("shape", "widths"), [((30,), (7,)), ((12, 9), (3, 3)), ((12, 9), (1, 5)), ((12, 9), (5, 1)), ((40, 37), (31, 31)), ((6, 7, 5), (3, 1, 5))])
def test_boxes_within(shape, widths):
    x = np.round(np.random.default_rng(2).normal(size=shape), 1)
    p = np.pad(x, [(w // 2, w // 2) for w in widths])
    np.testing.assert_array_equal(box_medians(p, widths), boxed(x, widths))


@pytest.mark.parametrize("cells", [4, 100, 4096])
@pytest.mark.parametrize(("shape", "widths"), [((11, 9), (3, 5)), ((20, 18), (15, 15)), ((4, 5, 6), (3, 3, 1)), ((17,), (5,))])
def test_boxes_in_tiles(spark, monkeypatch, cells, shape, widths):
    monkeypatch.setattr(medians, "TILE_CELLS", cells)
    x = np.random.default_rng(3).normal(size=shape)
    x.flat[4] = np.nan
    np.testing.assert_array_equal(toarray(lanes.medfilt(fromarray(spark, x), *widths)), boxed(x, widths))


def test_each_cell_goes_to_few_tiles(spark):
    """Once, and again where a box reaches over a tile's edge."""
    t = fromarray(spark, np.zeros((128, 128)))
    plan = lanes.medfilt(t, 3, 3).df._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate explode") == 2
    with pytest.raises(ValueError, match="box"):
        lanes.medfilt(t, 2, 3)


def near(found, want, tolerance):
    left = list(want)
    for z in found:
        k = int(np.argmin(np.abs(np.array(left) - z)))
        assert abs(left.pop(k) - z) <= tolerance * (1 + abs(z))


@pytest.mark.parametrize("degree", [1, 2, 3, 8, 20])
def test_roots_of_many_polynomials(degree):
    rng = np.random.default_rng(degree)
    c = rng.normal(size=(50, degree + 1))
    c[7, -1] = 0
    if degree > 2:
        c[8, -2:] = 0
    got = all_roots(c)
    for row, z in zip(c, got, strict=True):
        near(z, np.roots(row), 1e-6)


def test_roots_apart_together_and_at_zero():
    near(aberth(np.poly([1e-8, 1.0, 1e8])[None].astype(complex))[0], [1e-8, 1.0, 1e8], 1e-6)
    near(all_roots(np.poly([2.0, 2.0, 2.0])[None])[0], [2.0] * 3, 1e-4)
    near(all_roots(np.poly(np.arange(1, 11.0))[None])[0], np.arange(1, 11.0), 1e-6)
    near(all_roots(np.array([[1.0, 0, 0, 0, -1]]))[0], [1, -1, 1j, -1j], 1e-12)
    near(all_roots(np.array([[1 + 1j, 2, -3j]]))[0], np.roots([1 + 1j, 2, -3j]), 1e-12)
    assert all_roots(np.array([[3.0, 0, 0]])).tolist() == [[0, 0]]
    for bad in ([[0.0, 1]], [[1.0]]):
        with pytest.raises(ValueError):
            all_roots(np.array(bad))
