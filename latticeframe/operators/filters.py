"""Digital filters: designs on the driver (a handful of numbers), filtering along lanes in tasks.

Designs follow the published textbook formulas: an analog lowpass prototype, a band transform and
the bilinear transform, as zeros, poles and gain (z, p, k).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..functions import complexes
from ..tensor import COMPLEX, Tensor, matched

Zpk = tuple[np.ndarray, np.ndarray, float]
BANDS = ("lowpass", "highpass", "bandpass", "bandstop")


def buttap(n: int) -> Zpk:
    """Analog Butterworth prototype."""
    m = np.arange(-n + 1, n, 2)
    return np.zeros(0, complex), -np.exp(1j * np.pi * m / (2 * n)), 1.0


def cheby1ap(n: int, ripple: float) -> Zpk:
    eps = math.sqrt(10 ** (ripple / 10) - 1)
    mu = math.asinh(1 / eps) / n
    theta = np.pi * np.arange(-n + 1, n, 2) / (2 * n)
    p = -np.sinh(mu + 1j * theta)
    k = np.prod(-p).real
    return np.zeros(0, complex), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k


def cheby2ap(n: int, attenuation: float) -> Zpk:
    eps = 1 / math.sqrt(10 ** (attenuation / 10) - 1)
    mu = math.asinh(1 / eps) / n
    m = np.concatenate((np.arange(-n + 1, 0, 2), np.arange(2, n, 2))) if n % 2 else np.arange(-n + 1, n, 2)
    z = -np.conj(1j / np.sin(m * np.pi / (2 * n)))
    p = -np.exp(1j * np.pi * np.arange(-n + 1, n, 2) / (2 * n))
    p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
    return z, p, (np.prod(-p) / np.prod(-z)).real


def _quarter(m: float) -> float:
    """The complete elliptic integral of the first kind by the arithmetic-geometric mean."""
    a, b = 1.0, math.sqrt(1 - m)
    while abs(a - b) > 1e-15 * a:
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _sn(u: complex, m: float) -> tuple[complex, complex, complex]:
    """Jacobi's sn, cn and dn by descending Landen steps."""
    ks, k = [], math.sqrt(m)
    while k > 1e-12:
        ks.append(k)
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
    ks.append(k)
    for x in ks[1:]:
        u = u / (1 + x)
    s = np.sin(u)
    for x in reversed(ks[1:]):
        s = (1 + x) * s / (1 + x * s * s)
    return s, np.sqrt(1 - s * s), np.sqrt(1 - m * s * s)


def _degree(n: int, m1: float) -> float:
    """The modulus m for which the order's degree equation holds, by nomes."""
    q = math.exp(-math.pi * _quarter(1 - m1) / _quarter(m1)) ** (1 / n)
    top = sum(q ** (i * (i + 1)) for i in range(8))
    low = 1 + 2 * sum(q ** (i * i) for i in range(1, 9))
    return 16 * q * (top / low) ** 4


def ellipap(n: int, ripple: float, attenuation: float) -> Zpk:
    """Elliptic prototype."""
    eps = math.sqrt(10 ** (ripple / 10) - 1)
    if n == 1:
        p = -1 / eps
        return np.zeros(0, complex), np.array([p], complex), -p
    m1 = eps * eps / (10 ** (attenuation / 10) - 1)
    m = _degree(n, m1)
    big, k = _quarter(m), math.sqrt(m)
    j = np.arange(1 - n % 2, n, 2)
    s = np.array([_sn(x * big / n, m) for x in j])
    inside = s[np.abs(s[:, 0]) > 1e-12, 0]
    z = 1j / (k * inside)
    z = np.concatenate((z, np.conj(z)))
    # v0 with sc(v0) = 1 / eps in the complementary modulus of m1
    v0 = big / (n * _quarter(m1)) * _inverse_sc(1 / eps, 1 - m1)
    sv, cv, dv = _sn(v0, 1 - m)
    p = -(s[:, 1] * s[:, 2] * sv * cv + 1j * s[:, 0] * dv) / (1 - (s[:, 2] * sv) ** 2)
    if n % 2:
        real = np.abs(p.imag) <= 1e-12 * np.abs(p)
        p = np.concatenate((p, np.conj(p[~real])))
    else:
        p = np.concatenate((p, np.conj(p)))
    gain = (np.prod(-p) / np.prod(-z)).real
    return z, p, gain / math.sqrt(1 + eps * eps) if n % 2 == 0 else gain


def _inverse_sc(w: float, m: float) -> float:
    """u with sn(u) / cn(u) = w: the incomplete integral at atan(w), by the same mean."""
    a, b, phi, n = 1.0, math.sqrt(1 - m), math.atan(w), 1.0
    while abs(a - b) > 1e-15 * a:
        phi += math.atan(b / a * math.tan(phi)) + math.pi * math.floor(phi / math.pi + 0.5)
        a, b, n = (a + b) / 2, math.sqrt(a * b), 2 * n
    return phi / (n * a)


# band transforms


def lptolpzpk(z, p, k: float, cutoff: float) -> Zpk:
    z, p = np.atleast_1d(z), np.atleast_1d(p)
    return z * cutoff, p * cutoff, k * cutoff ** (len(p) - len(z))


def lptohpzpk(z, p, k: float, cutoff: float) -> Zpk:
    z, p = np.atleast_1d(z), np.atleast_1d(p)
    gain = (np.prod(-z) / np.prod(-p)).real
    return np.concatenate((cutoff / z, np.zeros(len(p) - len(z)))), cutoff / p, k * gain


def _split_roots(x: np.ndarray, center: float) -> np.ndarray:
    d = np.sqrt(x.astype(complex) ** 2 - center**2)
    return np.concatenate((x + d, x - d))


def lptobpzpk(z, p, k: float, center: float, width: float) -> Zpk:
    z, p = np.atleast_1d(z) * width / 2, np.atleast_1d(p) * width / 2
    more = len(p) - len(z)
    return np.concatenate((_split_roots(z, center), np.zeros(more))), _split_roots(p, center), k * width**more


def lptobszpk(z, p, k: float, center: float, width: float) -> Zpk:
    z, p = np.atleast_1d(z), np.atleast_1d(p)
    gain, more = (np.prod(-z) / np.prod(-p)).real, len(p) - len(z)
    notch = np.concatenate((np.full(more, 1j * center), np.full(more, -1j * center)))
    return np.concatenate((_split_roots(width / 2 / z, center), notch)), _split_roots(width / 2 / p, center), k * gain


def bilinearzpk(z, p, k: float, rate: float) -> Zpk:
    z, p, two = np.atleast_1d(z), np.atleast_1d(p), 2 * rate
    gain = (np.prod(two - z) / np.prod(two - p)).real
    return np.concatenate(((two + z) / (two - z), -np.ones(len(p) - len(z)))), (two + p) / (two - p), k * gain


def zpktotf(z, p, k: float) -> tuple[np.ndarray, np.ndarray]:
    b, a = k * np.poly(z), np.poly(p)
    return np.real(b), np.real(a)


def tftozpk(b, a) -> Zpk:
    b, a = np.trim_zeros(np.atleast_1d(b), "f"), np.trim_zeros(np.atleast_1d(a), "f")
    return np.roots(b), np.roots(a), float(b[0] / a[0])


def _by_zpk(b, a, f: Callable, *args: float) -> tuple[np.ndarray, np.ndarray]:
    return zpktotf(*f(*tftozpk(b, a), *args))


def lptolp(b, a, cutoff: float):
    return _by_zpk(b, a, lptolpzpk, cutoff)


def lptohp(b, a, cutoff: float):
    return _by_zpk(b, a, lptohpzpk, cutoff)


def lptobp(b, a, center: float, width: float):
    return _by_zpk(b, a, lptobpzpk, center, width)


def lptobs(b, a, center: float, width: float):
    return _by_zpk(b, a, lptobszpk, center, width)


def _pairs(x: np.ndarray) -> list[np.ndarray]:
    """Conjugate pairs, then real values two by two."""
    x = np.asarray(x, complex)
    upper = x[x.imag > 1e-10 * np.maximum(1, np.abs(x))]
    real = np.sort(x[np.abs(x.imag) <= 1e-10 * np.maximum(1, np.abs(x))].real)
    out = [np.array([v, np.conj(v)]) for v in upper]
    return out + [real[i : i + 2].astype(complex) for i in range(0, len(real), 2)]


def zpktosos(z, p, k: float) -> np.ndarray:
    """Second-order sections, those with poles nearest the circle last; each takes the zeros nearest to its poles."""
    poles, zeros = _pairs(p), _pairs(z)
    poles.sort(key=lambda v: np.abs(1 - np.abs(v)).min())
    rows = []
    for pair in poles:
        if zeros:
            fits = [i for i, v in enumerate(zeros) if len(v) == len(pair)] or list(range(len(zeros)))
            at = min(fits, key=lambda i: abs(zeros[i][0] - pair[0]))
            chosen = zeros.pop(at)
        else:
            chosen = np.zeros(0)
        b, a = np.real(np.poly(chosen)), np.real(np.poly(pair))
        rows.append(np.concatenate((np.pad(b, (3 - len(b), 0) if len(b) < len(a) else (0, 3 - len(b))) if len(a) == 3 else np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a))))))
    rows.reverse()
    sos = np.array(rows)
    sos[0, :3] *= k
    return sos


PROTOTYPES: dict[str, Callable[..., Zpk]] = {"butter": buttap, "cheby1": cheby1ap, "cheby2": cheby2ap, "ellip": ellipap}


def design(name: str, n: int, band: str, cutoff: float | tuple[float, float], *args: float, rate: float = 2.0) -> Zpk:
    """A digital filter; ``args``: ripple of cheby1, attenuation of cheby2, both of ellip, in dB."""
    if band not in BANDS:
        raise ValueError(f"band {band}")
    edges = np.atleast_1d(np.asarray(cutoff, float)) / rate
    if len(edges) != (2 if band in BANDS[2:] else 1) or (edges <= 0).any() or (edges >= 0.5).any() or (np.diff(edges) <= 0).any():
        raise ValueError(f"cutoff {cutoff}")
    z, p, k = PROTOTYPES[name](n, *args)
    w = 2 * np.tan(np.pi * edges)
    if band == "lowpass":
        z, p, k = lptolpzpk(z, p, k, w[0])
    elif band == "highpass":
        z, p, k = lptohpzpk(z, p, k, w[0])
    else:
        z, p, k = (lptobpzpk if band == "bandpass" else lptobszpk)(z, p, k, math.sqrt(w[0] * w[1]), w[1] - w[0])
    return bilinearzpk(z, p, k, 1.0)


def design_ba(name: str, *args, **kwargs) -> tuple[np.ndarray, np.ndarray]:
    return zpktotf(*design(name, *args, **kwargs))


def design_sos(name: str, *args, **kwargs) -> np.ndarray:
    return zpktosos(*design(name, *args, **kwargs))


# filtering


#: Longer lanes are filtered in pieces of about the root of their length, all at once.
PIECED = 4096


def _recursed(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Direct form II transposed over a lane in each row, from a state in each row: the output and the final states."""
    y = np.empty(x.shape, z.dtype)
    z = np.concatenate((z, np.zeros((len(z), 1), z.dtype)), axis=1)
    for i in range(x.shape[1]):
        v = x[:, i]
        y[:, i] = out = b[0] * v + z[:, 0]
        z[:, :-1] = z[:, 1:] + np.outer(v, b[1:]) - np.outer(out, a[1:])
    return y, z[:, :-1]


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The output and the final state of one lane, or of a lane in each row.

    A long lane is cut into pieces that are filtered together from rest. Then states go from piece to
    piece, each by a matrix, and add their response.
    """
    n = max(len(a), len(b))
    b, a = np.pad(np.asarray(b, float) / a[0], (0, n - len(b))), np.pad(np.asarray(a, float) / a[0], (0, n - len(a)))
    lanes = np.atleast_2d(x)
    kind = np.result_type(x, float) if zi is None else np.result_type(x, zi, float)
    z = np.zeros((len(lanes), n - 1), kind) if zi is None else np.array(np.broadcast_to(zi, (len(lanes), n - 1)), kind)
    length = lanes.shape[1]
    if length > PIECED:
        size = math.isqrt(length)
        count = length // size
        y, own = _recursed(b, a, lanes[:, : count * size].reshape(-1, size), np.zeros((len(lanes) * count, n - 1), kind))
        y, own = y.reshape(len(lanes), count, size), own.reshape(len(lanes), count, n - 1)
        response, step = _recursed(b, a, np.zeros((n - 1, size)), np.eye(n - 1))
        for k in range(count):
            y[:, k] += z @ response
            z = z @ step + own[:, k]
        rest, z = _recursed(b, a, lanes[:, count * size :], z)
        y = np.concatenate((y.reshape(len(lanes), -1), rest), axis=1)
    else:
        y, z = _recursed(b, a, lanes, z)
    return (y, z) if np.ndim(x) == 2 else (y[0], z[0])


def filtered_sos(sos: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after the other: the output and their final states (section x 2, for each lane if there are several)."""
    states = []
    for k, s in enumerate(sos):
        x, z = filtered(s[:3], s[3:], x, None if zi is None else np.asarray(zi)[..., k, :])
        states.append(z)
    return x, np.stack(states, axis=-2)


#: Cells of a block of a long lane; blocks are filtered by different tasks.
BLOCK = 1 << 16


def _along(t: Tensor, run: Callable, axis: int, start: np.ndarray) -> tuple[Tensor, Tensor]:
    """Lanes filtered by ``run``, which takes lanes and states in rows and returns both, from one state: output and final states."""
    from .convolution import _lanes

    k, states = t.axis(axis), len(start)
    is_complex = t.kind == COMPLEX or np.iscomplexobj(start)
    if states and t.shape[k] > BLOCK:
        return _in_blocks(t, run, k, start, is_complex)
    begun = lambda x: run(x, np.broadcast_to(start, (len(x), states)))
    y = _lanes(t, axis, lambda x: begun(x)[0], is_complex, None if t.keys else t.shape[k])
    return y, _lanes(t, axis, lambda x: begun(x)[1], is_complex, states)


def _in_blocks(t: Tensor, run: Callable, k: int, start: np.ndarray, is_complex: bool) -> tuple[Tensor, Tensor]:
    """Long lanes: blocks from rest give what each adds to the state, a lane's states go from block to block by a
    matrix, and blocks are filtered again, each from its own state, which comes before its cells."""
    from .convolution import _lanes

    here, others, m = t.axes[k], [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)], len(start)
    held = tuple(f"_k{a}" for a in others)
    names = [F.col(a).alias(b) for a, b in zip(others, held, strict=True)]
    value = F.col("v") if t.kind == COMPLEX or not is_complex else complexes.make(F.col("v"))
    cells = t.df.select(*names, F.floor(F.col(here) / BLOCK).cast("long").alias("_b"), F.pmod(F.col(here), F.lit(BLOCK)).alias("i0"), value.alias("v"))
    rest = _lanes(Tensor(cells, 1, (*held, "_b"), (BLOCK,)), 0, lambda x: run(x, np.zeros((len(x), m)))[1], is_complex, m)
    move = np.concatenate([run(np.zeros((len(e), BLOCK)), e)[1] for e in np.array_split(np.eye(m), -(-m // 16))])

    def carried(added: np.ndarray) -> np.ndarray:
        added = added.reshape(len(added), -1, m)
        z, out = np.broadcast_to(start, (len(added), m)), np.empty(added.shape, np.result_type(added, start))
        for j in range(added.shape[1]):
            out[:, j] = z
            z = z @ move + added[:, j]
        return out.reshape(len(out), -1)

    states = _lanes(Tensor(rest.df.select(*held, (F.col("_b") * m + F.col("i0")).alias("i0"), "v"), 1, held), 0, carried, is_complex)
    first = states.df.select(*held, F.floor(F.col("i0") / m).cast("long").alias("_b"), F.pmod(F.col("i0"), F.lit(m)).alias("i0"), "v")
    both = first.unionByName(cells.withColumn("i0", F.col("i0") + m))
    back = [F.col(b).alias(a) for a, b in zip(others, held, strict=True)]
    keyed = lambda df: Tensor(df, 1, (*held, "_b"), (BLOCK + m,))
    y = _lanes(keyed(both), 0, lambda x: run(x[:, m:], x[:, :m])[0], is_complex)
    out = t.cells(y.df.select(*back, (F.col("_b") * BLOCK + F.col("i0")).alias(here), "v"), extents=None if t.keys else t.shape)
    last = cells.groupBy(*held).agg(F.max("_b").alias("_last"))
    ends = matched(both, last, list(held)) if held else both.crossJoin(F.broadcast(last))
    z = _lanes(keyed(ends.filter("_b = _last").drop("_last")), 0, lambda x: run(x[:, m:], x[:, :m])[1], is_complex, m)
    shape = None if t.keys else tuple(m if j == k else n for j, n in enumerate(t.shape))
    return out, t.cells(z.df.select(*back, F.col("i0").alias(here), "v"), extents=shape)


def zlfilter(t: Tensor, b, a, zi: np.ndarray | None = None, axis: int = -1) -> tuple[Tensor, Tensor]:
    """Filters with b / a from a given state (default rest) and returns the final state too."""
    b, a = np.atleast_1d(b).astype(float), np.atleast_1d(a).astype(float)
    if a[0] == 0:
        raise ValueError("a begins with 0")
    start = np.zeros(max(len(a), len(b)) - 1) if zi is None else np.ravel(zi)
    return _along(t, lambda x, z: filtered(b, a, x, z), axis, start)


def lfilter(t: Tensor, b, a, axis: int = -1) -> Tensor:
    return zlfilter(t, b, a, None, axis)[0]


def zsosfilter(t: Tensor, sos, zi: np.ndarray | None = None, axis: int = -1) -> tuple[Tensor, Tensor]:
    sos = np.atleast_2d(sos)

    def run(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y, end = filtered_sos(sos, x, z.reshape(len(z), len(sos), 2))
        return y, end.reshape(len(z), -1)

    return _along(t, run, axis, np.zeros(2 * len(sos)) if zi is None else np.ravel(zi))


def sosfilter(t: Tensor, sos, axis: int = -1) -> Tensor:
    return zsosfilter(t, sos, None, axis)[0]
