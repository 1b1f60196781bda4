"""Inverses of convolutions against recursion, with blocks and tiles so small that there are many."""

import numpy as np
import pandas as pd
import pytest
from latticeframe.operators import convolution, division, filters
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.operators.division import divider, series
from latticeframe.tensor import Tensor


def recursion(y, h):
    """Cell by cell."""
    x = np.zeros([n - m + 1 for n, m in zip(y.shape, h.shape, strict=True)], np.result_type(y, h, float))
    for at in np.ndindex(*x.shape):
        span = [min(i, m - 1) + 1 for i, m in zip(at, h.shape, strict=True)]
        back = x[tuple(slice(i - s + 1, i + 1) for i, s in zip(at, span, strict=True))]
        x[at] = (y[at] - (h[tuple(slice(0, s) for s in span)] * back[(slice(None, None, -1),) * h.ndim]).sum()) / h[(0,) * h.ndim]
    return x


def full(x, h):
    out = np.zeros([n + m - 1 for n, m in zip(x.shape, h.shape, strict=True)], np.result_type(x, h))
    for at in np.ndindex(*h.shape):
        out[tuple(slice(i, i + n) for i, n in zip(at, x.shape, strict=True))] += h[at] * x
    return out


def random(*shape, seed=1):
    return np.random.default_rng(seed).normal(size=shape)


KERNELS = [np.array([2.0, 1.0, -0.25]), np.array([4.0]), np.array([1.0, -0.9]), np.concatenate([[3.0], random(40) / 20]), np.array([1.0, 3.0, 0.5]), np.array([1 + 1j, 0.5j])]


@pytest.mark.parametrize("h", KERNELS, ids=range(len(KERNELS)))
def test_series(h):
    n = 10 if h[-1] == 0.5 else 50  # beyond, the terms of an unstable kernel's series are too large for transforms
    g = series(h, (n,))
    np.testing.assert_allclose(np.convolve(g, h)[:n], np.eye(1, n)[0], atol=1e-9 * np.abs(g).max())


def test_series_in_several_variables():
    h = np.zeros((3, 2, 2))
    h[0, 0, 0] = 4
    h += random(3, 2, 2) / 4
    g = series(h, (6, 5, 7))
    want = np.zeros((6, 5, 7))
    want[0, 0, 0] = 1
    np.testing.assert_allclose(full(g, h)[:6, :5, :7], want, atol=1e-12)


@pytest.mark.parametrize("size", [1, 4, 16, 4096])
@pytest.mark.parametrize("h", KERNELS, ids=range(len(KERNELS)))
def test_lanes_go_on_where_they_were_cut(h, size, monkeypatch):
    monkeypatch.setattr(division, "SERIES", size)
    n = 14 if h[-1] == 0.5 else 70  # an unstable kernel loses digits
    x = random(3, n)
    y = np.stack([full(r, h) for r in x])
    run = divider(h)
    z, parts, at = np.zeros((3, len(h) - 1), y.dtype), [], 0
    for width in (1, 5, 2, n - 8):
        got, z = run(y[:, at : at + width], z)
        parts.append(got)
        at += width
    np.testing.assert_allclose(np.concatenate(parts, 1), x, atol=1e-7)


def test_growing_series_of_few_bits_are_exact():
    h, x = np.array([0.5, 1.0, -0.25]), np.round(1024 * random(2, 64)) / 1024
    y = np.stack([full(r, h) for r in x])
    np.testing.assert_array_equal(divider(h)(y, np.zeros((2, 2)))[0][:, :64], x)


@pytest.mark.parametrize("block", [7, 64])
def test_long_lanes_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(filters, "BLOCK", block)
    monkeypatch.setattr(division, "SERIES", 16)
    for h in KERNELS[:4]:
        x = random(2, 150)
        y = np.stack([full(r, h) for r in x])
        np.testing.assert_allclose(toarray(convolution.deconvolve1d(fromarray(spark, y), fromarray(spark, h), 1)), x, atol=1e-9)
        np.testing.assert_allclose(toarray(convolution.deconvolve1d(fromarray(spark, y[0]), fromarray(spark, h))), recursion(y[0], h), atol=1e-9)
        np.testing.assert_allclose(toarray(convolution.decorrelate1d(fromarray(spark, y[1]), fromarray(spark, h[::-1].copy()))), x[1], atol=1e-9)


def test_a_lane_of_a_million_cells(spark):
    """Over 16 blocks, each a task's."""
    h = np.array([2.0, 1.0, -0.25])
    x = random(10**6)
    y = np.convolve(x, h)
    t = Tensor(spark.createDataFrame(pd.DataFrame({"i0": np.arange(len(y)), "v": y})), 1, (), (len(y),))
    got = convolution.deconvolve1d(t, fromarray(spark, h)).df.toPandas().sort_values("i0")
    assert got.i0.tolist() == list(range(10**6))
    np.testing.assert_allclose(got.v.to_numpy(), x, atol=1e-9)


@pytest.mark.parametrize("side", [2, 4, 64])
def test_arrays_in_waves(spark, monkeypatch, side):
    monkeypatch.setattr(division, "SIDES", (side,) * 4)
    for shape, kernel in (((9, 6), (2, 2)), ((5, 8), (4, 1)), ((4, 3, 5), (2, 1, 3))):
        h = random(*kernel, seed=3) / 4
        h[(0,) * h.ndim] = 3
        x = random(*shape)
        np.testing.assert_allclose(toarray(convolution.deconvolve(fromarray(spark, full(x, h)), fromarray(spark, h))), x, atol=1e-9)
    grows = np.array([[0.5, 1.0], [1.0, -0.25]])  # cells of few bits stay exact all the same
    few = np.round(64 * random(8, 7)) / 64
    np.testing.assert_allclose(toarray(convolution.deconvolve(fromarray(spark, full(few, grows)), fromarray(spark, grows))), few, atol=1e-12)
    z = random(6, 5) + 1j * random(6, 5, seed=2)
    h = np.array([[4.0, 1j], [0.5, -0.5]])
    np.testing.assert_allclose(toarray(convolution.deconvolve(fromarray(spark, full(z, h)), fromarray(spark, h))), z, atol=1e-9)


def test_long_narrow_arrays_in_blocks(spark, monkeypatch):
    """By two jobs instead of one for each tile, with the same results as in waves, also where y is no convolution."""
    h = np.array([[4.0, 1.0], [0.5, -0.5], [0.25, 1.0]])
    monkeypatch.setattr(division, "BLOCK", 40)
    x, steps, written = random(90, 5), [], division.written
    monkeypatch.setattr(division, "written", lambda df, *a: steps.append(1) or written(df, *a))
    monkeypatch.setattr(division, "SIDES", (4,) * 4)
    for turned in (False, True):
        own, y = (h.T, full(x, h).T) if turned else (h, full(x, h))
        np.testing.assert_allclose(toarray(convolution.deconvolve(fromarray(spark, y), fromarray(spark, own))), x.T if turned else x, atol=1e-9)
    assert len(steps) == 2
    np.testing.assert_allclose(toarray(convolution.decorrelate(fromarray(spark, full(x, h)), fromarray(spark, h[::-1, ::-1].copy()))), x, atol=1e-9)
    assert len(steps) == 3
    z = random(4, 50, 3) + 1j * random(4, 50, 3, seed=2)
    k = np.array([[[4.0, 1j]], [[0.5, -0.5]], [[0.25, 0.0]]]).swapaxes(0, 1)
    np.testing.assert_allclose(toarray(convolution.deconvolve(fromarray(spark, full(z, k)), fromarray(spark, k))), z, atol=1e-9)
    odd = [(key, i, j, float(v)) for key in ("a", None) for (i, j), v in np.ndenumerate(random(92, 6, seed=len(key or ""))) if (i // 9) % 3]
    t = Tensor(spark.createDataFrame(odd, "key string, i0 long, i1 long, v double"), 2, ("key",), (92, 6))
    both = []
    for most in (8, 1000):
        monkeypatch.setattr(division, "MOST_WAVES", most)
        both.append({(r.key, r.i0, r.i1): r.v for r in convolution.deconvolve(t, fromarray(spark, h)).df.collect()})
    assert both[0].keys() == both[1].keys() and len(both[0]) == 2 * 90 * 5
    assert max(abs(both[0][k] - both[1][k]) for k in both[0]) < 1e-9


def test_many_arrays_holes_and_refusals(spark, monkeypatch):
    monkeypatch.setattr(division, "SIDES", (3,) * 4)
    h = np.array([[4.0, 1.0], [0.5, -0.5]])
    arrays = {k: random(7, 4, seed=s) for s, k in enumerate(("a", "b", None))}
    arrays["b"][:3, :3] = 0
    rows = [(k, *at, float(v)) for k, x in arrays.items() for at, v in np.ndenumerate(full(x, h)) if v]
    t = Tensor(spark.createDataFrame(rows, "key string, i0 long, i1 long, v double"), 2, ("key",), (8, 5))
    got = {(r.key, r.i0, r.i1): r.v for r in convolution.deconvolve(t, fromarray(spark, h)).df.collect()}
    assert len(got) == 3 * 28 and all(abs(got[k, *at] - v) < 1e-9 for k, x in arrays.items() for at, v in np.ndenumerate(x))
    two = fromarray(spark, random(2, 2))
    assert convolution.deconvolve(two, fromarray(spark, np.ones((3, 1)))).df.count() == 0
    with pytest.raises(ValueError, match="begins with 0"):
        convolution.deconvolve(two, fromarray(spark, [[0.0, 1.0]]))
    with pytest.raises(ValueError, match="ranks"):
        convolution.deconvolve(two, fromarray(spark, [1.0]))


@pytest.mark.parametrize("taps", [3, 16, 17, 40])
def test_convolution_tap_by_tap(spark, monkeypatch, taps):
    """By cells or by blocks: a cell that isn't a number touches no more than its own products."""
    monkeypatch.setattr(convolution, "FFT_BLOCK", 32)
    x, h = random(100), random(taps, seed=2)
    x[50] = np.nan
    for mode in ("full", "same", "valid"):
        np.testing.assert_allclose(toarray(convolution.convolve1d(fromarray(spark, x), fromarray(spark, h), mode)), np.convolve(x, h, mode), atol=1e-12)
    z, k = random(6, 20) + 1j * random(6, 20, seed=3), random(3, 7, seed=4) * 1j
    np.testing.assert_allclose(toarray(convolution.convolve(fromarray(spark, z), fromarray(spark, k))), full(z, k), atol=1e-12)
