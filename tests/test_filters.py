import numpy as np
import pytest
from latticeframe.operators import filters
from latticeframe.operators.creation import fromarray, toarray


def response(z, p, k, f):
    w = np.exp(2j * np.pi * np.asarray(f))
    return np.abs(k * np.prod(w[:, None] - z, axis=1) / np.prod(w[:, None] - p, axis=1))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("name,args", [("butter", ()), ("cheby1", (1.0,)), ("cheby2", (40.0,)), ("ellip", (1.0, 40.0))])
def test_designs_keep_their_bounds(n, name, args):
    f = np.linspace(0.001, 0.499, 400)
    for band, cutoff in (("lowpass", 0.2), ("highpass", 0.2), ("bandpass", (0.1, 0.2)), ("bandstop", (0.1, 0.2))):
        z, p, k = filters.design(name, n, band, cutoff, *args, rate=1.0)
        assert (np.abs(p) < 1).all()
        h = response(z, p, k, f)
        edge = response(z, p, k, np.atleast_1d(cutoff))
        if name == "butter":
            np.testing.assert_allclose(edge, np.sqrt(0.5), rtol=1e-6)
        if name in ("cheby1", "ellip"):
            inside = {"lowpass": f < 0.2, "highpass": f > 0.2, "bandpass": (f > 0.1) & (f < 0.2), "bandstop": (f < 0.1) | (f > 0.2)}[band]
            assert h[inside].min() > 10 ** (-1.0001 / 20) and h.max() < 1 + 1e-6
            np.testing.assert_allclose(edge, 10 ** (-1 / 20), rtol=1e-6)
        if name == "cheby2":
            outside = {"lowpass": f > 0.2, "highpass": f < 0.2, "bandpass": (f < 0.1) | (f > 0.2), "bandstop": (f > 0.1) & (f < 0.2)}[band]
            assert h[outside].max() < 10 ** (-39.999 / 20)
        if name == "ellip" and n >= 4 and band == "lowpass":
            # deep in the stop band the attenuation holds, and it is reached
            assert h[f > 0.4].max() < 10 ** (-39.99 / 20)
            sharper = filters.design("butter", n, band, 0.2, rate=1.0)
            assert (h < 0.01)[f > 0.2].sum() > 0 and (h[f > 0.2] < 0.0101).argmax() <= (response(*sharper, f)[f > 0.2] < 0.0101).argmax()
        b, a = filters.zpktotf(z, p, k)
        w = np.exp(-2j * np.pi * f)
        if n <= 4:
            np.testing.assert_allclose(np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w)), h, rtol=1e-5, atol=1e-8)
        sos = filters.zpktosos(z, p, k)
        total = np.prod([np.abs(np.polyval(s[2::-1], w) / np.polyval(s[:2:-1], w)) for s in sos], axis=0)
        np.testing.assert_allclose(total, h, rtol=1e-6, atol=1e-9)


def test_transforms_of_coefficients():
    b, a = filters.lptohp([1.0], [1.0, 1.0], 2.0)
    np.testing.assert_allclose(b / a[0], [1, 0], atol=1e-12)
    np.testing.assert_allclose(a / a[0], [1, 2])
    z, p, k = filters.tftozpk([2.0, -2.0], [1.0, -0.5])
    np.testing.assert_allclose(filters.zpktotf(z, p, k)[0], [2, -2])
    for f, args in ((filters.lptolp, (2.0,)), (filters.lptobp, (2.0, 1.0)), (filters.lptobs, (2.0, 1.0))):
        assert len(f([1.0], [1.0, 1.0], *args)[1]) in (2, 3)
    with pytest.raises(ValueError):
        filters.design("butter", 2, "lowpass", 0.7, rate=1.0)


def test_filtering_lanes_and_states(spark):
    x = np.random.default_rng(1).normal(size=(2, 48))
    b, a = filters.design_ba("butter", 3, "lowpass", 0.2, rate=1.0)
    t = fromarray(spark, x)
    want = np.zeros_like(x)
    for i in range(48):
        want[:, i] = sum(b[j] * x[:, i - j] for j in range(4) if i >= j) - sum(a[j] * want[:, i - j] for j in range(1, 4) if i >= j)
    np.testing.assert_allclose(toarray(filters.lfilter(t, b, a)), want, atol=1e-12)
    sos = filters.design_sos("butter", 3, "lowpass", 0.2, rate=1.0)
    np.testing.assert_allclose(toarray(filters.sosfilter(t, sos)), want, atol=1e-9)
    one = fromarray(spark, x[0, :20])
    y1, state = filters.zlfilter(one, b, a)
    y2, _ = filters.zlfilter(fromarray(spark, x[0, 20:]), b, a, toarray(state))
    np.testing.assert_allclose(np.concatenate((toarray(y1), toarray(y2))), want[0], atol=1e-12)
    y1, state = filters.zsosfilter(one, sos)
    y2, _ = filters.zsosfilter(fromarray(spark, x[0, 20:]), sos, toarray(state).reshape(-1, 2))
    np.testing.assert_allclose(np.concatenate((toarray(y1), toarray(y2))), want[0], atol=1e-9)
