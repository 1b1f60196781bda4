"""Keyed arrays of unequal lengths against NumPy, one array at a time."""

import numpy as np
import pytest
from latticeframe.operators import convolution, creation, filters, fourier, lanes, linalg, reductions, shape, sorting
from latticeframe.tensor import Tensor

LENGTHS = {"a": 5, "b": 3, "c": 8, "d": 1, None: 6}


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(7)
    return {k: rng.integers(-9, 9, n) + 0.5 for k, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def t(spark, arrays):
    rows = [(k, i, float(x)) for k, a in arrays.items() for i, x in enumerate(a)]
    return Tensor(spark.createDataFrame(rows, "key string, i0 long, v double").repartition(3), 1, ("key",))


def got(t):
    out = {}
    for r in t.df.collect():
        out.setdefault(r.key, {})[r.i0] = complex(r.v.re, r.v.im) if hasattr(r.v, "re") else r.v
    for k, cells in out.items():
        assert sorted(cells) == list(range(len(cells))), k
    return {k: np.array([cells[i] for i in range(len(cells))]) for k, cells in out.items()}


def check(t, arrays, f):
    found = got(t)
    want = {k: f(a) for k, a in arrays.items()}
    assert set(found) == {k for k, a in want.items() if len(a)}
    for k, a in found.items():
        assert np.allclose(a, want[k], atol=1e-9), k


def test_shape(t, arrays):
    check(shape.flip(t), arrays, lambda a: a[::-1])
    check(shape.reverse(t), arrays, lambda a: a[::-1])
    check(shape.flatten(t), arrays, lambda a: a)
    for k in (2, -3, 11):
        check(shape.roll(t, k), arrays, lambda a, k=k: np.roll(a, k))
        check(shape.roll(t, k, 0), arrays, lambda a, k=k: np.roll(a, k))
    check(shape.pad(t, 2, 1, 7.0), arrays, lambda a: np.pad(a, (2, 1), constant_values=7.0))
    check(shape.push(t, 4.0), arrays, lambda a: np.append(a, 4.0))
    left, last = shape.pop(t)
    check(left, arrays, lambda a: a[:-1])
    check(last, arrays, lambda a: a[-1:])
    check(shape.insert(t, 1, 3.0), arrays, lambda a: np.insert(a, 1, 3.0))
    check(shape.concat(t, shape.flip(t)), {k: a for k, a in arrays.items()}, lambda a: np.append(a, a[::-1]))


def test_transforms(t, arrays):
    check(fourier.fft(t, 16), arrays, lambda a: np.fft.fft(a, 16))
    check(fourier.fft(t, 4), arrays, lambda a: np.fft.fft(a, 4))
    check(fourier.rfft(t, 8), arrays, lambda a: np.fft.rfft(a, 8))
    check(fourier.irfft(fourier.rfft(t, 8), 8), arrays, lambda a: np.pad(a, (0, 8 - len(a))))
    check(fourier.dcttwo1d(t), arrays, lambda a: fourier._kernel("dcttwo", len(a)) @ a)
    check(fourier.dstone1d(t), arrays, lambda a: fourier._kernel("dstone", len(a)) @ a)
    check(fourier.dsttwo1d(t), arrays, lambda a: fourier._kernel("dsttwo", len(a)) @ a)
    long = Tensor(t.df.filter("key <> 'd'"), 1, ("key",))
    check(fourier.dctone1d(long), {k: a for k, a in arrays.items() if k and k != "d"}, lambda a: fourier._kernel("dctone", len(a)) @ a)


def recursion(b, a, x):
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    return y


def test_filters(t, arrays):
    b, a = [0.5, 0.25, -0.1], [1.0, -0.4, 0.2]
    check(filters.lfilter(t, b, a), arrays, lambda x: recursion(b, a, x))
    state = got(filters.zlfilter(t, b, a)[1])
    for k, x in arrays.items():
        longer = recursion(b, a, np.append(x, 0.0))
        assert state[k][0] == pytest.approx(longer[-1])  # the next output of silence
    sos = np.array([[0.5, 0.25, -0.1, 1.0, -0.4, 0.2], [1.0, 0.0, 0.5, 1.0, 0.1, 0.0]])
    check(filters.sosfilter(t, sos), arrays, lambda x: recursion(sos[1, :3], sos[1, 3:], recursion(sos[0, :3], sos[0, 3:], x)))


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolution(spark, t, arrays, mode):
    h = np.array([0.5, 1.0, -0.25])
    some = {k: a for k, a in arrays.items() if len(a) >= 3}
    long = Tensor(t.df.filter("key IS NULL OR key <> 'd'"), 1, ("key",))
    kernel = creation.fromarray(spark, h)
    for f in (convolution.convolve1d, convolution.fftconvolve1d):
        check(f(long, kernel, mode, 0), some, lambda a: np.convolve(a, h, mode))
    for f in (convolution.correlate1d, convolution.fftcorrelate1d):
        check(f(long, kernel, mode, 0), some, lambda a: np.convolve(a, h[::-1], mode))


def test_inverses(spark, t, arrays):
    kernel = creation.fromarray(spark, [2.0, 0.5])
    check(convolution.deconvolve1d(convolution.convolve1d(t, kernel, axis=0), kernel, 0), arrays, lambda a: a)
    check(convolution.fftdeconvolve1d(convolution.convolve1d(t, kernel, axis=0), kernel, 0), arrays, lambda a: a)
    found = got(convolution.roots(Tensor(t.df.filter("key <> 'd'"), 1, ("key",)), 0))
    for k, a in arrays.items():
        if k and k != "d":
            assert np.allclose(np.sort_complex(found[k]), np.sort_complex(np.roots(a)))


@pytest.mark.parametrize("large", [0, 1 << 20])
def test_lanes_and_quantiles(t, arrays, monkeypatch, large):
    monkeypatch.setattr(lanes, "BLOCK", 4)
    monkeypatch.setattr(sorting, "LARGE_KEY", large)
    backwards = creation.ordered(t.df.withColumn("at", -t.df.i0), t.df.v, ["at"], ["key"])
    check(backwards, arrays, lambda a: a[::-1])
    check(lanes.cumsum(t), arrays, np.cumsum)
    check(lanes.movmax(t, 3), arrays, lambda a: np.array([a[max(0, i - 1) : i + 2].max() for i in range(len(a))]))
    check(sorting.sort(t), arrays, np.sort)
    for q in (0.0, 0.3, 0.5, 1.0):
        found = {r.key: r.v for r in reductions.quantile(t, q).df.collect()}
        assert found == {k: pytest.approx(np.quantile(a, q)) for k, a in arrays.items()}


def test_quantile_of_ties_and_nan(spark):
    values = [3.0] * 500 + [1.0] * 20 + [7.0, 8.0]
    one = Tensor(spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i0 long, v double").repartition(4), 1)
    for q in (0.0, 0.02, 0.0384, 0.5, 0.99, 0.998, 1.0):
        assert reductions.quantile(one, q).df.first().v == pytest.approx(np.quantile(values, q))
    assert np.isnan(reductions.reduce("median", Tensor(one.df.unionByName(spark.createDataFrame([(999, float("nan"))], "i0 long, v double")), 1)).df.first().v)
    with pytest.raises(Exception, match="empty"):
        reductions.quantile(Tensor(one.df.limit(0), 1), 0.5).df.collect()


def test_filters_of_lanes_in_blocks(t, arrays, spark, monkeypatch):
    monkeypatch.setattr(filters, "BLOCK", 3)
    b, a = [0.5, 0.25, -0.1], [1.0, -0.4, 0.2]
    check(filters.lfilter(t, b, a), arrays, lambda x: recursion(b, a, x))
    zi = np.array([0.3, -0.2])
    y, z = (got(x) for x in filters.zlfilter(t, b, a, zi))
    for k, x in arrays.items():
        want, end = filters.filtered(b, a, x, zi)
        assert np.allclose(y[k], want) and np.allclose(z[k], end)
    sos = np.array([[0.5, 0.25, -0.1, 1.0, -0.4, 0.2], [1.0, 0.0, 0.5, 1.0, 0.1, 0.0]])
    y, z = (got(x) for x in filters.zsosfilter(t, sos))
    for k, x in arrays.items():
        want, end = filters.filtered_sos(sos, x)
        assert np.allclose(y[k], want) and np.allclose(z[k], end.ravel())
    one = creation.fromarray(spark, arrays["c"])
    assert np.allclose(creation.toarray(filters.lfilter(one, b, a)), recursion(b, a, arrays["c"]))
    assert np.allclose(creation.toarray(filters.zlfilter(one, b, a)[1]), filters.filtered(b, a, arrays["c"])[1])


def test_long_lanes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=20_000)
    one = Tensor(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i0 long, v double").repartition(4), 1, (), (len(x),))
    monkeypatch.setattr(fourier, "LONG", 1 << 10)
    n = 1 << 15
    assert np.allclose(creation.toarray(fourier.fft(one, n)), np.fft.fft(x, n), atol=1e-8)
    assert np.allclose(creation.toarray(fourier.rfft(one, n)), np.fft.rfft(x, n), atol=1e-8)
    assert np.allclose(creation.toarray(fourier.ifft(fourier.fft(one, n), n)).real[: len(x)], x, atol=1e-9)
    assert np.allclose(creation.toarray(fourier.irfft(fourier.rfft(one, n), n))[: len(x)], x, atol=1e-9)
    h = rng.normal(size=40)
    assert np.allclose(creation.toarray(convolution.fftconvolve1d(one, creation.fromarray(spark, h))), np.convolve(x, h), atol=1e-9)
    b, a = filters.design_ba("butter", 3, "lowpass", 0.2)
    assert np.allclose(creation.toarray(filters.lfilter(one, b, a)), recursion(b, a, x), atol=1e-9)


def test_blocks_of_matrices_are_convolved_like_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, h = rng.normal(size=(23, 17)), rng.normal(size=(4, 3))
    monkeypatch.setattr(convolution, "FFT_BLOCK", 64)
    a, k = creation.fromarray(spark, x), creation.fromarray(spark, h)
    for mode in ("full", "same", "valid"):
        assert np.allclose(creation.toarray(convolution.fftconvolve(a, k, mode)), creation.toarray(convolution.convolve(a, k, mode)), atol=1e-9)
        assert np.allclose(creation.toarray(convolution.fftcorrelate(a, k, mode)), creation.toarray(convolution.correlate(a, k, mode)), atol=1e-9)


def test_complex_products_and_differences(spark):
    z = np.array([1 + 2j, -0.5 + 1j, 2 - 1j, 0.25j])
    t = creation.fromarray(spark, z)
    assert np.allclose(creation.toarray(lanes.cumprod(t)), np.cumprod(z))
    r = reductions.sub(t).df.first().v
    assert complex(r.re, r.im) == pytest.approx(2 * z[0] - z.sum())
    assert linalg is not None
