"""Fourier, cosine and sine transforms along lanes, spectra of frames, mel features.

Lanes are transformed by NumPy inside tasks, many at once; a long lane is a matrix whose columns and rows
are such lanes. A ``dft`` by a join with a table of factors gives the same results in SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import complexes, reals
from ..tensor import COMPLEX, REAL, Tensor
from .convolution import _lanes
from .creation import fromarray, generated
from .elementwise import zipped
from .linalg import matmul
from .shape import frame, roll, transpose, truncate
from .windows import window


def _power(n: int) -> int:
    if n < 1 or n & (n - 1):
        raise ValueError(f"length {n} isn't a power of two")
    return n


#: Longer lanes are transformed in two steps of shorter lanes, so that no task holds one.
LONG = 1 << 16


def _turned(v: Column, angle: Column) -> Column:
    return complexes.mul(v, complexes.make(F.cos(angle), F.sin(angle)))


def _in_two_steps(t: Tensor, n: int, axis: int, sign: int) -> Tensor:
    """Sums over a lane times exp(sign 2 pi i j k / n), of the first ``n`` cells, zeros beyond: over rows of the lane as
    a matrix, turned, then over its columns."""
    k = t.axis(axis)
    here, others = t.axes[k], [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)]
    width = 1 << (n.bit_length() - 1) // 2
    height = n // width
    names = [f"_k{a}" for a in others]
    rows = t.df.filter(F.col(here) < n).select(*(F.col(a).alias(b) for a, b in zip(others, names, strict=True)), F.floor(F.col(here) / width).cast("long").alias("i0"), F.pmod(F.col(here), F.lit(width)).alias("i1"), "v")
    transform = np.fft.fft if sign < 0 else lambda x, m, axis: np.fft.ifft(x, m, axis) * m
    first = _lanes(Tensor(rows, 2, tuple(names), (height, width)), 0, lambda x: transform(x, height, 1), True, height)
    angle = F.lit(sign * 2 * math.pi / n) * F.pmod(F.col("i0") * F.col("i1"), F.lit(n))
    turned = Tensor(first.df.withColumn("v", _turned(F.col("v"), angle)), 2, tuple(names), (height, width))
    second = _lanes(turned, 1, lambda x: transform(x, width, 1), True, width)
    back = second.df.select(*(F.col(b).alias(a) for a, b in zip(others, names, strict=True)), (F.col("i0") + F.col("i1") * height).alias(here), "v")
    return t.cells(back, extents=None if t.keys else tuple(n if j == k else m for j, m in enumerate(t.shape)))


def _of_any_length(t: Tensor, n: int, axis: int, sign: int) -> Tensor:
    """``_in_two_steps`` for any ``n``: turned by a chirp, a lane's transform is its convolution with the chirp turned back
    (Bluestein), which transforms of a power of two make."""
    if not n & (n - 1):
        return _in_two_steps(t, n, axis, sign)
    k, m = t.axis(axis), padded_length(2 * n - 1)
    here = t.axes[k]
    chirp = lambda at, way: F.lit(way * math.pi / n) * F.pmod(at * at, F.lit(2 * n))
    value = F.col("v") if t.kind == COMPLEX else complexes.make(F.col("v"))
    turned = t.df.filter(F.col(here) < n).withColumn("v", _turned(value, chirp(F.col(here), sign)))
    extents = tuple(m if j == k else x for j, x in enumerate(t.shape))
    spectrum = _in_two_steps(t.cells(turned, extents=extents), m, axis, -1)
    back = t.df.sparkSession.range(1 - n, n).select(F.pmod("id", F.lit(m)).alias("i0"), chirp(F.col("id"), -sign).alias("angle"))
    other = _in_two_steps(Tensor(back.select("i0", complexes.make(F.cos("angle"), F.sin("angle")).alias("v")), 1, (), (m,)), m, 0, -1)
    both = spectrum.df.join(other.df.select(F.col("i0").alias(here), F.col("v").alias("_w")), here)
    product = spectrum.cells(both.withColumn("v", complexes.mul(F.col("v"), F.col("_w"))), extents=extents)
    found = _in_two_steps(product, m, axis, 1).df.filter(F.col(here) < n)
    cells = found.withColumn("v", complexes.scale(_turned(F.col("v"), chirp(F.col(here), sign)), F.lit(1 / m)))
    return t.cells(cells, extents=tuple(n if j == k else x for j, x in enumerate(t.shape)))


def _is_long(t: Tensor, axis: int) -> bool:
    """Whether a lane is more than a task should hold; arrays with keys, whose lanes have lengths of their own, aren't looked at."""
    return not t.keys and t.shape[t.axis(axis)] > LONG


def fft(t: Tensor, n: int | None = None, axis: int = -1) -> Tensor:
    """Of the first ``n`` cells of each lane, zeros beyond its end; by default the (longest) lane's length, a power of two."""
    n = _power(t.shape[t.axis(axis)] if n is None else n)
    if n > LONG:
        return _in_two_steps(t, n, axis, -1)
    return _lanes(t, axis, lambda x: np.fft.fft(x, n), True, n)


def rfft(t: Tensor, n: int | None = None, axis: int = -1) -> Tensor:
    t.need(REAL)
    k = t.axis(axis)
    n = _power(t.shape[k] if n is None else n)
    if n > LONG:
        return truncate(_in_two_steps(t, n, axis, -1), n // 2 + 1, axis)
    return _lanes(t, axis, lambda x: np.fft.rfft(x, n), True, n // 2 + 1)


def ifft(t: Tensor, n: int | None = None, axis: int = -1) -> Tensor:
    n = _power(t.shape[t.axis(axis)] if n is None else n)
    if n > LONG:
        return _in_two_steps(t, n, axis, 1).map(lambda v: complexes.scale(v, F.lit(1 / n)))
    return _lanes(t, axis, lambda x: np.fft.ifft(x, n), True, n)


def irfft(t: Tensor, n: int | None = None, axis: int = -1) -> Tensor:
    n = _power(2 * (t.shape[t.axis(axis)] - 1) if n is None else n)
    if n > LONG:  # the other half of the spectrum mirrors this one
        here = t.axes[t.axis(axis)]
        half = t.df.filter(F.col(here) <= n // 2).select(*t.places, "v")
        mirrored = half.filter((F.col(here) > 0) & (F.col(here) < n // 2)).withColumn(here, n - F.col(here)).withColumn("v", complexes.conj(F.col("v")))
        return ifft(t.cells(half.unionByName(mirrored)), n, axis).map(lambda v: v["re"])
    return _lanes(t, axis, lambda x: np.fft.irfft(x, n), False, n)


def padded_length(n: int) -> int:
    """The least power of two that isn't below n."""
    return 1 << max(0, n - 1).bit_length()


def fft2(t: Tensor, rows: int | None = None) -> Tensor:
    """``rows``: length to which zeros extend the first axis."""
    return fft(fft(t, axis=-1), rows, -2)


def rfft2(t: Tensor, rows: int | None = None) -> Tensor:
    return fft(rfft(t, axis=-1), rows, -2)


def ifft2(t: Tensor) -> Tensor:
    return ifft(ifft(t, axis=-1), axis=-2)


def irfft2(t: Tensor) -> Tensor:
    return irfft(ifft(t, axis=-2), axis=-1)


def dft(t: Tensor, bins: int | None = None) -> Tensor:
    """The transform of the last axis by a join: each cell meets the factors of all bins; sums begin within tasks."""
    t.need(REAL)
    k, n = t.ndim - 1, t.shape[-1]
    table = t.df.sparkSession.range(bins or n).select(F.col("id").alias("bin"))
    turn = F.lit(-2 * math.pi / n) * F.pmod(F.col("bin") * F.col(f"i{k}"), F.lit(n))
    rows = t.df.crossJoin(F.broadcast(table))
    others = [*t.keys, *t.axes[:-1]]
    out = rows.groupBy(*others, "bin").agg(F.sum(F.col("v") * F.cos(turn)).alias("re"), F.sum(F.col("v") * F.sin(turn)).alias("im"))
    cells = out.select(*others, F.col("bin").alias(f"i{k}"), F.struct("re", "im").alias("v"))
    return t.cells(cells, extents=(*t.shape[:-1], bins or n))


def fftfreq(spark: SparkSession, n: int, spacing: float = 1.0) -> Tensor:
    return generated(spark, (n,), lambda i: F.when(i < (n + 1) // 2, i).otherwise(i - n) / F.lit(n * spacing))


def rfftfreq(spark: SparkSession, n: int, spacing: float = 1.0) -> Tensor:
    return generated(spark, (n // 2 + 1,), lambda i: i / F.lit(n * spacing))


def fftshift(t: Tensor, axis: int = -1) -> Tensor:
    return roll(t, t.shape[t.axis(axis)] // 2, axis)


def ifftshift(t: Tensor, axis: int = -1) -> Tensor:
    return roll(t, -(t.shape[t.axis(axis)] // 2), axis)


def _kernel(name: str, n: int) -> np.ndarray:
    """The matrix of a cosine or sine transform of n points, without scaling factors."""
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    if name == "dctone":
        ends = np.where((i == 0) | (i == n - 1), 1.0, 2.0)
        return ends * np.cos(np.pi * k * i / (n - 1))
    if name == "dcttwo":
        return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))
    if name == "dstone":
        return 2 * np.sin(np.pi * (k + 1) * (i + 1) / (n + 1))
    return 2 * np.sin(np.pi * (k + 1) * (2 * i + 1) / (2 * n))


def _trigonometric(name: str, x: np.ndarray) -> np.ndarray:
    """The transforms of ``_kernel`` for a lane in each row, by the transform of the lanes mirrored."""
    n = x.shape[1]
    none = np.zeros((len(x), 1))
    if name == "dctone":
        if n < 2:
            raise ValueError("DCT-I needs two points")
        return np.fft.rfft(np.concatenate((x, x[:, -2:0:-1]), axis=1)).real
    if name == "dstone":
        return -np.fft.rfft(np.concatenate((none, x, none, -x[:, ::-1]), axis=1)).imag[:, 1 : n + 1]
    turn = lambda k: np.exp(-0.5j * np.pi * k / n)
    if name == "dcttwo":
        return (np.fft.fft(np.concatenate((x, x[:, ::-1]), axis=1))[:, :n] * turn(np.arange(n))).real
    return -(np.fft.fft(np.concatenate((x, -x[:, ::-1]), axis=1))[:, 1 : n + 1] * turn(np.arange(1, n + 1))).imag


def _long_cosines(name: str, t: Tensor, axis: int) -> Tensor:
    """``_trigonometric`` of long lanes: of type two by the transform of a lane's even places and then its odd ones
    backwards (a sine transform is the cosine transform of alternating signs, backwards), of type one of the lane mirrored."""
    k = t.axis(axis)
    here, n, extents = t.axes[k], t.shape[k], t.shape
    at, v = F.col(here), F.col("v")
    if name in ("dcttwo", "dsttwo"):
        signed = v * F.when(F.pmod(at, F.lit(2)) == 1, -1.0).otherwise(1.0) if name == "dsttwo" else v
        place = F.when(F.pmod(at, F.lit(2)) == 0, F.floor(at / 2)).otherwise(n - 1 - F.floor(at / 2)).cast("long")
        dealt = t.df.select(*(place.alias(a) if a == here else F.col(a) for a in t.axes), signed.alias("v"))
        found = _of_any_length(t.cells(dealt, extents=extents), n, axis, -1).df
        value = 2 * _turned(v, F.lit(-math.pi / (2 * n)) * at)["re"]
        return t.cells(found.select(*((n - 1 - at if name == "dsttwo" else at).alias(a) if a == here else F.col(a) for a in t.axes), value.alias("v")), extents=extents)
    first = 0 if name == "dctone" else 1
    size = 2 * n - 2 if name == "dctone" else 2 * n + 2
    inner = t.df.filter((at > 0) & (at < n - 1)) if name == "dctone" else t.df
    moved = lambda df, place, value: df.select(*(place.cast("long").alias(a) if a == here else F.col(a) for a in t.axes), value.alias("v"))
    mirrored = moved(t.df, at + first, v).unionByName(moved(inner, F.lit(size - first) - at, v if name == "dctone" else -v))
    found = _of_any_length(t.cells(mirrored, extents=tuple(size if j == k else m for j, m in enumerate(extents))), size, axis, -1).df
    kept = found.filter((at >= first) & (at < n + first))
    return t.cells(moved(kept, at - first, v["re"] if name == "dctone" else -v["im"]), extents=extents)


def _cosines(name: str, t: Tensor, axis: int) -> Tensor:
    t.need(REAL)
    if _is_long(t, axis):
        return _long_cosines(name, t, axis)
    return _lanes(t, axis, lambda x: _trigonometric(name, x), False, None if t.keys else t.shape[t.axis(axis)])


def dctone1d(t: Tensor, axis: int = -1) -> Tensor:
    return _cosines("dctone", t, axis)


def dcttwo1d(t: Tensor, axis: int = -1) -> Tensor:
    return _cosines("dcttwo", t, axis)


def dstone1d(t: Tensor, axis: int = -1) -> Tensor:
    return _cosines("dstone", t, axis)


def dsttwo1d(t: Tensor, axis: int = -1) -> Tensor:
    return _cosines("dsttwo", t, axis)


def _analytic(x: np.ndarray, length: int | None = None) -> np.ndarray:
    n = x.shape[1] if length is None else length
    if n % 2:
        raise ValueError("an odd length")
    keep = np.zeros(n)
    keep[0] = keep[n // 2] = 1
    keep[1 : n // 2] = 2
    return np.fft.ifft(np.fft.fft(x, n) * keep)


def _long_analytic(t: Tensor, axis: int, length: int | None = None) -> Tensor:
    """``_analytic`` of long lanes."""
    k = t.axis(axis)
    n = t.shape[k] if length is None else length
    if n % 2:
        raise ValueError("an odd length")
    at = F.col(t.axes[k])
    spectrum = _of_any_length(t, n, axis, -1)
    kept = spectrum.df.filter(at <= n // 2).withColumn("v", complexes.scale(F.col("v"), F.when((at == 0) | (at == n // 2), 1 / n).otherwise(2 / n)))
    return _of_any_length(spectrum.cells(kept, extents=spectrum.shape), n, axis, 1)


def _own(t: Tensor, axis: int) -> int | None:
    return None if t.keys else t.shape[t.axis(axis)]


def hilbert1d(t: Tensor, axis: int = -1) -> Tensor:
    """The analytic signal."""
    t.need(REAL)
    if _is_long(t, axis):
        return _long_analytic(t, axis)
    return _lanes(t, axis, _analytic, True, _own(t, axis))


def hilbert1dr(t: Tensor, axis: int = -1) -> Tensor:
    t.need(REAL)
    if _is_long(t, axis):
        return _long_analytic(t, axis).map(lambda v: v["im"])
    return _lanes(t, axis, lambda x: _analytic(x).imag, False, _own(t, axis))


def hilbert2(t: Tensor, rows: int | None = None) -> Tensor:
    """The analytic signal in both directions: positive frequencies of either axis. ``rows``: length to which zeros extend the first."""
    one = _long_analytic(t, -1) if _is_long(t, -1) else _lanes(t, -1, _analytic, True, _own(t, -1))
    n = t.shape[-2] if rows is None else rows
    if not t.keys and n > LONG:
        return _long_analytic(one, -2, n)
    return _lanes(one, -2, lambda x: _analytic(x, n), True, n)


def stft(t: Tensor, n: int, hop: int, shape: str = "hanning", rate: float = 1.0) -> tuple[Tensor, Tensor, Tensor]:
    """Frequencies, times of the frames' centres, and frames (time x bin); a short signal is one padded frame."""
    spark = t.df.sparkSession
    length = t.shape[-1]
    if length < n:
        from .shape import pad

        t = pad(t, 0, n - length, 0.0, -1)
    cut = frame(t, n, hop, -1)
    weighted = zipped(cut, window(spark, shape, n), lambda v, w: complexes.scale(v, w) if t.kind == COMPLEX else v * w)
    frames = fft(weighted) if t.kind == COMPLEX else rfft(weighted)
    freqs = fftfreq(spark, n, 1 / rate) if t.kind == COMPLEX else rfftfreq(spark, n, 1 / rate)
    times = generated(spark, (cut.shape[-2],), lambda i: (i * hop + n / 2) / F.lit(float(rate)))
    return freqs, times, frames


def istft(frames: Tensor, n: int, hop: int, shape: str = "hanning") -> Tensor:
    """Overlap-add of the frames' inverse transforms, over the sum of squared weights."""
    weights = window(frames.df.sparkSession, shape, n).df.select(F.col("i0").alias("_w"), F.col("v").alias("w"))
    back = irfft(frames, n)
    k = back.ndim - 2
    rows = back.df.join(F.broadcast(weights), F.col(f"i{k + 1}") == F.col("_w"))
    others = [*back.keys, *back.axes[:k]]
    at = (F.col(f"i{k}") * hop + F.col(f"i{k + 1}")).alias(f"i{k}")
    sums = rows.select(*others, at, "v", "w").groupBy(*others, f"i{k}").agg(F.sum(F.col("v") * F.col("w")).alias("a"), F.sum(F.col("w") * F.col("w")).alias("b"))
    cells = sums.select(*others, f"i{k}", F.when(F.col("b") > 1e-12, F.col("a") / F.col("b")).otherwise(0.0).alias("v"))
    return back.cells(cells, back.ndim - 1, (*back.shape[:k], (back.shape[k] - 1) * hop + n))


def _mel(f: np.ndarray) -> np.ndarray:
    return 2595 * np.log10(1 + np.asarray(f) / 700)


def mfbank(spark: SparkSession, filters: int, n: int, rate: float, low: float = 0.0, high: float | None = None) -> Tensor:
    """Triangular filters (filter x bin) between edges even in mel, each of area one."""
    edges = 700 * (10 ** (np.linspace(_mel(low), _mel(high or rate / 2), filters + 2) / 2595) - 1)
    bins = np.arange(n // 2 + 1) * rate / n
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rise, fall = (bins - left) / (mid - left), (right - bins) / (right - mid)
    return fromarray(spark, np.maximum(0, np.minimum(rise, fall)) * 2 / (right - left))


#: Least value that is taken the logarithm of.
LOG_FLOOR = 1e-10


def mlogfbank(spark: SparkSession, filters: int, n: int, rate: float, low: float = 0.0, high: float | None = None) -> Tensor:
    return mfbank(spark, filters, n, rate, low, high).map(lambda v: F.ln(F.greatest(v, F.lit(LOG_FLOOR))))


def mfcc(t: Tensor, coefficients: int, filters: int, n: int, hop: int, rate: float) -> Tensor:
    """Mel-frequency cepstral coefficients (time x coefficient) of a real signal."""
    _, _, frames = stft(t, n, hop, rate=rate)
    power = frames.map(lambda z: z["re"] * z["re"] + z["im"] * z["im"])
    energies = matmul(power, transpose(mfbank(t.df.sparkSession, filters, n, rate)))
    logs = energies.map(lambda v: reals.ln(F.greatest(v, F.lit(LOG_FLOOR))))
    table = np.sqrt(2 / filters) * _kernel("dcttwo", filters)[:coefficients] / 2
    table[0] /= np.sqrt(2)
    return matmul(logs, fromarray(t.df.sparkSession, table.T))
