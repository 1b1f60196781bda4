"""Operators on small arrays against NumPy."""

import math

import numpy as np
import pytest
from latticeframe.operators import convolution, creation, elementwise, fourier, indexing, lanes, linalg, reductions, shape, sorting, strings, windows
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.plans.registry import MARKING, OPERATORS, SYNTAX
from latticeframe.tensor import Tensor
from pyspark.sql import functions as F

RNG = np.random.default_rng(7)
A = RNG.normal(size=(3, 4))
B = RNG.normal(size=(3, 4))
Z = A + 1j * B
ODD = np.array([7.0, np.inf, -np.inf, np.nan, 0.0])


def close(t, want, tolerance=1e-9):
    got = toarray(t)
    assert got.shape == np.shape(want)
    np.testing.assert_allclose(got, want, atol=tolerance, rtol=tolerance)


def test_every_operator_is_there():
    assert len(OPERATORS) > 360 and all(callable(f) for f in OPERATORS.values())
    assert all(callable(f) for f in SYNTAX.values())


@pytest.mark.parametrize("name", ["exp", "sqrt", "cbrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "sign", "abs"])
def test_complex_functions(spark, name):
    want = {"cbrt": lambda z: z ** (1 / 3), "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "sign": lambda z: z / np.abs(z)}
    close(elementwise.unary(name, fromarray(spark, Z)), want.get(name, getattr(np, name, None))(Z))


def test_arithmetic_and_broadcasting(spark):
    a, b, z = (fromarray(spark, x) for x in (A, B, Z))
    row, column = fromarray(spark, A[0]), fromarray(spark, A[:, :1])
    close(a + b, A + B)
    close(a - row, A - A[0])
    close(column * b, A[:, :1] * B)
    close(z * a, Z * A)
    close(z / z, np.ones((3, 4), complex))
    close(2 ** a, 2**A)
    close(elementwise.binary("pow", z, 0.5 + 0j), Z**0.5)
    close(a / 0, np.where(A > 0, np.inf, -np.inf))
    close(1 / fromarray(spark, [2.0, 0.0]), [0.5, np.inf])
    with pytest.raises(Exception, match="division by zero"):
        toarray(a / fromarray(spark, np.zeros((3, 4))))
    with pytest.raises(ValueError):
        a + fromarray(spark, np.ones(3))
    a += 1
    close(a, A + 1)
    close(fromarray(spark, A)[1:2, 0], A[1:3])
    close(fromarray(spark, A)[0:3:2, 1], A[:, 0:4:2])
    close(fromarray(spark, A).put((1, 2), 5.0)[1, 2], 5.0)


def test_ieee_values(spark):
    t = fromarray(spark, ODD)
    for name, want in {"isnan": np.isnan, "isinf": np.isinf, "isfin": np.isfinite}.items():
        close(elementwise.unary(name, t), want(ODD).astype(float))
    close(elementwise.binary("gt", t, 1.0), (ODD > 1).astype(float))
    close(elementwise.binary("lt", 1.0, t), (ODD > 1).astype(float))
    close(elementwise.binary("ne", t, t), (ODD != ODD).astype(float))
    close(elementwise.binary("maximum", t, 1.0), np.fmax(ODD, 1))
    close(elementwise.binary("minimum", t, 1.0), np.fmin(ODD, 1))
    close(elementwise.clip(t, -1, 1), np.clip(ODD, -1, 1))
    close(elementwise.unary("floor", fromarray(spark, [1e300, -2.5, 2.5])), [1e300, -3, 2])
    close(elementwise.unary("round", fromarray(spark, [0.5, 1.5, 2.5, -0.5])), [0, 2, 2, 0])
    q, r = elementwise.divmod_(fromarray(spark, [7.0, -7.0, 7.0]), fromarray(spark, [-3.0, 3.0, 3.0]))
    close(q, [-3, -3, 2])
    close(r, [-2, 2, 1])
    close(elementwise.binary("log", fromarray(spark, [8.0, 0.0]), 2.0), [3, -np.inf])
    for name in ("min", "max", "median", "sum", "mean"):
        assert math.isnan(toarray(reductions.reduce(name, t)))
    assert toarray(reductions.argmin(t)).tolist() == [3] and toarray(reductions.argmax(t)).tolist() == [3]


def test_reductions(spark):
    t, z = fromarray(spark, A), fromarray(spark, Z)
    for axis in (0, 1, -1):
        for name, f in {"sum": np.sum, "prod": np.prod, "mean": np.mean, "std": np.std, "var": np.var, "median": np.median, "min": np.min, "max": np.max}.items():
            close(reductions.reduce(name, t, axis), f(A, axis=axis))
        close(reductions.percentile(t, 30, axis), np.percentile(A, 30, axis=axis))
        close(reductions.argmin(t, axis), A.argmin(axis))
        for name, f in {"sum": np.sum, "prod": np.prod, "mean": np.mean, "std": np.std, "var": np.var}.items():
            close(reductions.reduce(name, z, axis), f(Z, axis=axis))
    close(reductions.norm(t, 3), (np.abs(A) ** 3).sum() ** (1 / 3))
    close(reductions.norm(z, 1, 0), np.abs(Z).sum(axis=0))
    close(reductions.sub(fromarray(spark, [1.0, 2.0, 3.0, 4.0])), -8)
    empty = creation.empty(spark, (3,))
    assert [float(toarray(reductions.reduce(n, empty))) for n in ("sum", "prod", "all", "any")] == [0, 1, 1, 0]
    with pytest.raises(Exception, match="empty"):
        toarray(reductions.reduce("min", empty))
    with pytest.raises(ValueError):
        reductions.reduce("sum", fromarray(spark, [1.0]), 0)
    with pytest.raises(ValueError):
        t.axis(2)


def test_shape(spark):
    t = fromarray(spark, A)
    close(shape.reshape(t, 2, 6), A.reshape(2, 6))
    close(shape.transpose(fromarray(spark, A.reshape(3, 2, 2)), 2, 0, 1), A.reshape(3, 2, 2).transpose(2, 0, 1))
    close(shape.flip(t), A[::-1, ::-1])
    close(shape.roll(t, 5), np.roll(A, 5))
    close(shape.roll(t, -1, 0), np.roll(A, -1, 0))
    close(shape.pad(t, 1, 2, 7.0), np.pad(A, (1, 2), constant_values=7))
    close(shape.resize(t, 2, 8), np.append(A.ravel(), [0] * 4).reshape(2, 8))
    close(shape.concat(t, t), np.concatenate((A.ravel(), A.ravel())))
    close(shape.concat(creation.empty(spark, (7,)), fromarray(spark, [1.0, 2.0])), [1, 2])
    close(shape.stack(t, t * 2, axis=1), np.stack((A, A * 2), 1))
    close(shape.frame(fromarray(spark, np.arange(7.0)), 3, 2), [[0, 1, 2], [2, 3, 4], [4, 5, 6]])
    left, gone = shape.remove(fromarray(spark, np.arange(5.0)), 1, 2)
    close(left, [0, 3, 4])
    close(gone, [1, 2])
    close(shape.insert(fromarray(spark, [1.0, 2.0]), 1, 9.0), [1, 9, 2])
    close(shape.pop(shape.push(fromarray(spark, [1.0]), 3.0))[1], [3])


def test_indexing(spark):
    t = fromarray(spark, A)
    close(indexing.getslice(t, 0, 3, 2, 0), A[0:3:2])
    with pytest.raises(ValueError):
        indexing.getslice(t, 0, 4, 1, 0)
    with pytest.raises(ValueError):
        indexing.get(t, 1)
    mask = (A > 0).astype(float)
    close(indexing.select(t, fromarray(spark, mask)), A[A > 0])
    close(indexing.compress(t, fromarray(spark, [1.0, 0.0, 1.0]), 1), A[:, [0, 2]])
    close(elementwise.where(fromarray(spark, mask), t, fromarray(spark, B)), np.where(A > 0, A, B))
    close(elementwise.putmask(t, 0.0, fromarray(spark, mask)), np.where(A > 0, 0, A))
    close(indexing.argnonzero(fromarray(spark, mask)), np.argwhere(mask))
    close(indexing.bincount(fromarray(spark, [0.0, 1, 1, 3])), [1, 2, 0, 1])
    close(indexing.bincount(fromarray(spark, [0.0, 1, 1, 3]), fromarray(spark, [0.5, 1, 2, 4])), [0.5, 3, 0, 4])
    with pytest.raises(Exception, match="whole numbers"):
        toarray(indexing.bincount(fromarray(spark, [0.5])))
    source, queries = fromarray(spark, [1.0, 3, 3, 5]), fromarray(spark, [0.0, 3, 4, 6])
    close(indexing.searchsorted(source, queries), [0, 1, 3, 4])
    close(indexing.searchsorted(source, queries, True), [0, 3, 3, 4])
    assert indexing.indexof(source, 9).df.count() == 0


def test_lanes(spark, monkeypatch):
    monkeypatch.setattr(lanes, "BLOCK", 7)  # many blocks
    x = RNG.normal(size=50)
    t = fromarray(spark, x)
    close(lanes.cumsum(t), x.cumsum())
    close(lanes.cumprod(t), x.cumprod())
    close(lanes.diff(t), np.diff(x))
    close(lanes.grad(t), np.gradient(x))
    for w in (1, 4, 5):
        windows_of = [x[max(0, i - w // 2) : i + w - w // 2] for i in range(50)]
        for name, f in {"movmean": np.mean, "movmedian": np.median, "movmin": np.min, "movmax": np.max, "movstd": np.std, "movvar": np.var}.items():
            close(getattr(lanes, name)(t, w), [f(v) for v in windows_of])
    close(lanes.medfilt1d(fromarray(spark, [2.0, 9, 1, 8, 3, 7, 4]), 3), [2, 2, 8, 3, 7, 4, 4])
    close(lanes.cumsum(fromarray(spark, Z), 1), Z.cumsum(1))
    close(lanes.cumsum(fromarray(spark, A)), A.ravel().cumsum().reshape(3, 4))
    phase = np.cumsum(RNG.uniform(-2.5, 2.5, 50))
    wrapped = (phase + np.pi) % (2 * np.pi) - np.pi
    close(lanes.unwrap(fromarray(spark, wrapped), 2 * np.pi), np.unwrap(wrapped))
    close(lanes.zcr(fromarray(spark, [1.0, -1, 0, 2, -3, -1e-12, 4, 0, -2, 5, 6, -7])), 7 / 12)
    close(lanes.normalize(fromarray(spark, A), 2, 0), A / np.linalg.norm(A, axis=0))
    close(lanes.normalize(fromarray(spark, A)), A / np.abs(A).sum())
    grid = np.array([[1.0, 9, 2, 3], [4, 1, 8, 2], [3, 5, 1, 7]])
    padded = np.pad(grid, ((1, 1), (0, 0)))
    close(lanes.medfilt(fromarray(spark, grid), 3, 1), np.median(np.stack([padded[i : i + 3] for i in range(3)]), axis=1))


def test_order_and_sets(spark):
    x = np.array([3.0, 1, np.nan, 2, 2, -5])
    t = fromarray(spark, x)
    close(sorting.sort(t), np.sort(x))
    close(sorting.sort(fromarray(spark, A), 0), np.sort(A, 0))
    close(sorting.argsort(t), np.argsort(x, kind="stable"))
    close(sorting.unique(fromarray(spark, [0.0, -0.0, np.nan, np.nan, 1])), [0, 1, np.nan])
    close(sorting.perm(fromarray(spark, [1.0, 2, 3])), [[1, 2, 3], [2, 1, 3], [3, 1, 2], [1, 3, 2], [2, 3, 1], [3, 2, 1]])
    close(sorting.sort(sorting.shuffle(fromarray(spark, A), 3), 1), toarray(sorting.sort(sorting.shuffle(fromarray(spark, A), 3), 1)))
    assert sorted(toarray(sorting.shuffle(fromarray(spark, A))).ravel()) == sorted(A.ravel())
    a, b = (sorting.likeset(fromarray(spark, v)) for v in ([3.0, 1, 2, 2], [4.0, 2]))
    close(sorting.setunion(a, b), [1, 2, 3, 4])
    close(sorting.setintersect(a, b), [2])
    close(sorting.setdiff(a, b), [1, 3])
    close(sorting.setsymdiff(a, b), [1, 3, 4])
    assert sorting.setissubset(sorting.setintersect(a, b), a) == 1 and sorting.setisequal(a, b) == 0 and sorting.setcontains(a, 3) == 1
    with pytest.raises(ValueError, match="set"):
        sorting.setunion(a + 1, b)


@pytest.mark.parametrize("few", [0, 64])
def test_ranks_by_ranges(spark, monkeypatch, few):
    monkeypatch.setattr(sorting, "FEW_LIMITS", few)
    x = np.random.default_rng(5).integers(0, 40, 300) / 4
    t = fromarray(spark, x)
    close(sorting.sort(t), np.sort(x))
    close(sorting.sort(t, descending=True), np.sort(x)[::-1])
    close(reductions.quantile(t, 0.37), np.quantile(x, 0.37))
    close(sorting.unique(t), np.unique(x))


def test_linear_algebra(spark):
    m = RNG.normal(size=(4, 4))
    t = fromarray(spark, m)
    close(linalg.inv(t), np.linalg.inv(m))
    close(linalg.det(t), np.linalg.det(m))
    close(linalg.det(fromarray(spark, [[1.0, 2], [2, 4]])), 0)
    close(linalg.solve(t, fromarray(spark, m[:, 0] * 2)), [2, 0, 0, 0])
    close(linalg.solve(t, fromarray(spark, m @ A.T)), A.T)
    with pytest.raises(Exception, match="singular"):
        toarray(linalg.inv(fromarray(spark, [[1.0, 2], [2, 4]])))
    batch = RNG.normal(size=(5, 2, 3))
    close(linalg.matmul(fromarray(spark, batch), fromarray(spark, A)), batch @ A)
    close(linalg.matmul(fromarray(spark, Z), fromarray(spark, Z.T.copy())), Z @ Z.T)
    close(linalg.inner(fromarray(spark, A), fromarray(spark, B)), np.inner(A, B))
    close(linalg.outer(fromarray(spark, A[0]), fromarray(spark, B[0])), np.outer(A[0], B[0]))
    close(linalg.cross(fromarray(spark, A[0, :3]), fromarray(spark, B[0, :3])), np.cross(A[0, :3], B[0, :3]))
    close(linalg.diag(fromarray(spark, [1.0, 2])), np.diag([1, 2]))
    close(linalg.project(fromarray(spark, [3.0, 4, 0]), fromarray(spark, [1.0, 0, 0])), [3, 0, 0])
    close(linalg.reflect(fromarray(spark, [3.0, 4, 0]), fromarray(spark, [1.0, 0, 0])), [-3, 4, 0])
    x = np.arange(-2, 3.0)
    for k, row in enumerate(toarray(linalg.savgol(spark, 5, 3))):
        for p in range(4):
            assert abs(row @ x**p - (math.factorial(k) if p == k else 0)) < 1e-9


def test_convolution_and_inverses(spark):
    x, h = RNG.normal(size=9), np.array([1.0, 0.5, -0.25])
    t, k = fromarray(spark, x), fromarray(spark, h)
    for mode in ("full", "same", "valid"):
        close(convolution.convolve1d(t, k, mode), np.convolve(x, h, mode))
        close(convolution.correlate1d(t, k, mode), np.correlate(x, h, mode))
    g = np.array([0.2, 0.4, 1.0])
    for forward, back in (("convolve1d", "deconvolve1d"), ("correlate1d", "decorrelate1d"), ("convolve1d", "fftdeconvolve1d"), ("correlate1d", "fftdecorrelate1d")):
        taps = fromarray(spark, g if "orr" in forward else h)
        close(getattr(convolution, back)(getattr(convolution, forward)(t, taps), taps), x)
    box, boxed = fromarray(spark, [[2.0, 0.5], [0.3, 0.1]]), fromarray(spark, [[0.1, 0.3], [0.5, 2.0]])
    a = fromarray(spark, A)
    close(convolution.deconvolve(convolution.convolve(a, box), box), A)
    close(convolution.fftdeconvolve(convolution.convolve(a, box), box), A)
    close(convolution.decorrelate(convolution.correlate(a, boxed), boxed), A)
    close(convolution.fftdecorrelate(convolution.correlate(a, boxed), boxed), A)
    with pytest.raises(Exception, match="begins with 0"):
        toarray(convolution.deconvolve1d(t, fromarray(spark, [0.0, 1.0])))
    close(convolution.convolve1d(fromarray(spark, Z), fromarray(spark, [1j, 1.0]), axis=1), np.stack([np.convolve(r, [1j, 1]) for r in Z]))


def pchip(x, y):
    """Slopes of the monotone cubic, one by one."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    inner = [0.0 if d[k - 1] * d[k] <= 0 else 3 * (h[k] + h[k - 1]) / ((2 * h[k] + h[k - 1]) / d[k - 1] + (h[k] + 2 * h[k - 1]) / d[k]) for k in range(1, len(h))]
    return np.array([end(h[0], h[1], d[0], d[1]), *inner, end(h[-1], h[-2], d[-1], d[-2])])


@pytest.mark.parametrize("n", [2, 3, 40])
@pytest.mark.parametrize("block", [3, 65_536])
def test_cubics_through_long_tables(spark, monkeypatch, n, block):
    """Breakpoints in several blocks, and pieces that reach over several ranges."""
    from latticeframe.operators import lanes

    monkeypatch.setattr(lanes, "BLOCK", block)
    rng = np.random.default_rng(n)
    x, y = np.cumsum(rng.exponential(size=n) ** 4 + 0.01), np.round(rng.normal(size=n), 1)
    asked = np.concatenate([rng.uniform(x[0] - 1, x[-1] + 1, 60), x])
    got = toarray(convolution.interp(fromarray(spark, asked), fromarray(spark, x), fromarray(spark, y), "cubic"))
    a, s = np.clip(asked, x[0], x[-1]), pchip(x, y)
    k = np.clip(np.searchsorted(x, a, "right") - 1, 0, n - 2)
    w = x[k + 1] - x[k]
    u = (a - x[k]) / w
    want = y[k] * (1 - u) ** 2 * (1 + 2 * u) + y[k + 1] * u**2 * (3 - 2 * u) + w * (s[k] * u * (1 - u) ** 2 - s[k + 1] * u**2 * (1 - u))
    np.testing.assert_allclose(got, want, atol=1e-9)
    with pytest.raises(Exception, match="increase"):
        toarray(convolution.interp(fromarray(spark, asked), fromarray(spark, x[::-1].copy()), fromarray(spark, y)))


def test_interpolation(spark):
    x, y = fromarray(spark, [0.0, 1, 2, 3]), fromarray(spark, [0.0, 10, 20, 30])
    for mode, want in {"linear": 15, "nearest": 10, "previous": 10, "next": 20, "cubic": 15}.items():
        close(convolution.interp(fromarray(spark, [1.5]), x, y, mode), [want])
    close(convolution.interp(fromarray(spark, [-1.0, 4, np.nan]), x, y), [0, 30, np.nan])
    close(convolution.interp(fromarray(spark, [-1.0, 4]), x, y, bounds="nan"), [np.nan, np.nan])
    close(convolution.interp(fromarray(spark, [-1.0, 4]), x, y, bounds="extrapolate"), [-10, 40])
    with pytest.raises(Exception, match="outside"):
        toarray(convolution.interp(fromarray(spark, [-1.0]), x, y, bounds="refuse"))
    many = RNG.uniform(-1, 11, 200)
    xs, ys = np.sort(RNG.uniform(0, 10, 40)), RNG.normal(size=40)
    close(convolution.interp(fromarray(spark, many), fromarray(spark, xs), fromarray(spark, ys)), np.interp(many, xs, ys))
    close(convolution.resample(y, 7), [0, 5, 10, 15, 20, 25, 30])
    close(convolution.lagrange(fromarray(spark, [0.0, 1, 2]), fromarray(spark, [1.0, 3, 7])), [1, 1, 1])
    assert sorted(toarray(convolution.roots(fromarray(spark, [1.0, -3, 2]))).real) == pytest.approx([1, 2])


def test_transforms(spark):
    x = RNG.normal(size=(2, 8))
    t = fromarray(spark, x)
    close(fourier.fft(t), np.fft.fft(x))
    close(fourier.dft(t), np.fft.fft(x))
    close(fourier.rfft(t, 16), np.fft.rfft(x, 16))
    close(fourier.irfft(fourier.rfft(t)), x)
    close(fourier.rfft2(t), np.fft.rfft2(x))
    close(fourier.irfft2(fourier.rfft2(t)), x)
    close(fourier.ifft2(fourier.fft2(t)), x.astype(complex))
    with pytest.raises(ValueError):
        fourier.fft(fromarray(spark, np.ones(6)))
    close(fourier.fftshift(fourier.fftfreq(spark, 8, 1 / 8)), [-4, -3, -2, -1, 0, 1, 2, 3])
    analytic = toarray(fourier.hilbert1d(fromarray(spark, np.cos(2 * np.pi * np.arange(8) / 8))))
    np.testing.assert_allclose(analytic, np.exp(2j * np.pi * np.arange(8) / 8), atol=1e-12)
    signal = RNG.normal(size=64)
    freqs, times, frames = fourier.stft(fromarray(spark, signal), 16, 4, rate=16)
    assert freqs.shape == (9,) and frames.shape == (13, 9) and toarray(times)[1] == (4 + 8) / 16
    back = toarray(fourier.istft(frames, 16, 4))
    np.testing.assert_allclose(back[1:-1], signal[1:-1], atol=1e-9)
    bank = toarray(fourier.mfbank(spark, 6, 64, 8000))
    assert bank.shape == (6, 33) and (bank >= 0).all() and (bank.sum(axis=1) > 0).all()
    assert fourier.mfcc(fromarray(spark, signal), 5, 6, 16, 8, 8000).shape == (7, 5)


def test_closed_forms(spark):
    for name, f in {"hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}.items():
        close(windows.window(spark, name, 9), f(9))
        close(windows.window(spark, name, 1), [1])
    m = toarray(windows.rotmatypr(spark, 0.3, 0.2, 0.1))
    np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-12)
    close(windows.rotmat(spark, (0, 0, 2), np.pi / 2), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    harmonics = windows.sphharmacn(fromarray(spark, [[0.3, 0.2], [1.0, -0.5]]), 2)
    assert harmonics.shape == (9, 2)
    np.testing.assert_allclose(toarray(harmonics)[[0, 2], 0], [1, np.sin(0.2)], atol=1e-12)
    close(windows.every_pair(fromarray(spark, [100.0, 200]), fromarray(spark, [0.5, 1]), windows.rt60absp), [[32.2, 16.1], [64.4, 32.2]])


def test_harmonics_past_the_pole(spark):
    """An elevation beyond a right angle is the direction on the other side; all of a degree's squares add up to 1."""
    az, el = 0.3, 1.9
    close(windows.sphharmacn(fromarray(spark, [[az, el]]), 3), toarray(windows.sphharmacn(fromarray(spark, [[az + np.pi, np.pi - el]]), 3)))
    both = toarray(windows.sphharmacn(fromarray(spark, [[az, el]]), 3))[:, 0]
    close(fromarray(spark, both[:4]), [1, np.cos(el) * np.sin(az), np.sin(el), np.cos(el) * np.cos(az)])
    np.testing.assert_allclose([(both[n * n : (n + 1) ** 2] ** 2).sum() for n in range(4)], np.ones(4), atol=1e-12)


def test_strings(spark):
    words = ["1st héLLo-wORLD", "  ab\t", "", "x=y=z", "-1.5e3", "inf", "1d"]
    t = fromarray(spark, np.array(words, dtype=object))
    out = lambda name, *a: toarray(strings.apply(name, t, *a)).tolist()
    assert out("strtitle")[0] == "1St HéLlo-World"
    assert out("strupper")[0] == "1ST HéLLO-WORLD" and out("strcapitalize")[0] == "1st hello-world".replace("hello", "héllo")
    assert out("strstrip") == [w.strip() for w in words]
    assert out("strlen")[0] == len(words[0].encode())
    assert out("strcenter", 6, "*") == [w.center(6, "*") if len(w.encode()) == len(w) else w for w in words]
    assert out("strreplace", "=", "==", 1)[3] == "x==y=z" and out("strreplace", "", ".", 2)[3] == ".x.=y=z"
    assert out("strsubstr", 0, 5, 2) == [w.encode()[0:5:2].decode() for w in words]
    assert out("strfind", "=", 2)[3] == 3 and out("strrfind", "=")[3] == 3 and out("strfind", "q")[3] == -1
    numbers = out("strtonum")
    assert numbers[4:6] == [-1500.0, np.inf] and all(math.isnan(numbers[k]) for k in (0, 2, 6))
    assert out("tobase64")[1] == "ICBhYgk="
    assert toarray(strings.apply("numtostr", fromarray(spark, [1e16, 0.1, np.nan]))).tolist() == ["1e+16", "0.1", "nan"]
    assert toarray(strings.apply("tohex", fromarray(spark, [255.0, 2.0**63]), 4)).tolist() == ["00FF", "8000000000000000"]
    row = spark.range(1).select(
        strings.rsplit(F.lit("a,b,c"), ",", 1).alias("a"),
        strings.partition(F.lit("a,b,c"), ",").alias("b"),
        strings.rpartition(F.lit("abc"), ",").alias("c"),
        strings.codes(F.lit("é")).alias("d"),
        strings.decode(F.array(F.lit(195.0), F.lit(169.0))).alias("e"),
        strings.fromcodepoints(F.array(F.lit(128512.0))).alias("f"),
        strings.listasstr(F.array(F.lit(1.0), F.lit(2.5)), "|").alias("g"),
        strings.frombuffer(strings.tobuffer(F.array(F.lit(0.0), F.lit(255.0)), "|u1"), "|u1").alias("h"),
        strings.fromcodes(F.array(F.lit(72.0), F.lit(105.0))).alias("i"),
    ).first()
    assert row.a == ["a,b", "c"] and row.b == ["a", ",", "b,c"] and row.c == ["", "", "abc"]
    assert row.d == [195, 169] and row.e == "é" and row.f == "😀" and row.g == "1.0|2.5" and row.h == [0, 255] and row.i == "Hi"
    assert toarray(reductions.strjoin(t, ",")).item() == ",".join(words)
    close(strings.apply("frombinary", fromarray(spark, np.array(["0b101", "11"], dtype=object))), [5, 3])
    with pytest.raises(Exception, match="base"):
        toarray(strings.apply("frombinary", fromarray(spark, np.array(["2"], dtype=object))))


def test_creation_and_marks(spark):
    creation.seed(5)
    one = toarray(creation.rand(spark, (20,)))
    np.testing.assert_array_equal(one, toarray(creation.rand(spark, (20,))))
    creation.seed(42)
    assert ((one >= 0) & (one < 1)).all() and len(set(one)) == 20
    assert "shape (3, 4), real" in creation.text(fromarray(spark, A))
    assert creation.isempty(creation.empty(spark, (4,))) == 1 and creation.type_(fromarray(spark, Z)) == 1
    creation.totable(fromarray(spark, [1.0, 2]), "an_array")
    close(creation.fromtable(spark, "an_array"), [1, 2])
    keyed = creation.fromcolumn(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0])], "k string, x array<double>"), "x", ["k"])
    assert {r.k: r.v for r in reductions.reduce("sum", keyed).df.collect()} == {"a": 3.0, "b": 5.0}
    assert {r.k: r.data for r in creation.packed(keyed).collect()} == {"a": [1.0, 2.0], "b": [5.0]}
    assert OPERATORS["rtlock"](keyed).realtime and not OPERATORS["rtunlock"](keyed).realtime
    OPERATORS["rtlockstart"]()
    assert MARKING["note"]
    OPERATORS["rtlockend"]()
    with pytest.raises(ValueError):
        Tensor(keyed.df, 9)
