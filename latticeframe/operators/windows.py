"""Window shapes, coordinates, harmonics, levels and rooms: closed forms over index columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import reals
from ..tensor import REAL, Tensor
from .creation import fromarray, generated
from .elementwise import zipped

TAU = 2 * math.pi


def _raised(spark: SparkSession, n: int, f) -> Tensor:
    return generated(spark, (n,), lambda i: F.lit(1.0) if n == 1 else f(i / F.lit(float(n - 1))))


def hanning(spark: SparkSession, n: int) -> Tensor:
    return _raised(spark, n, lambda x: 0.5 - 0.5 * F.cos(TAU * x))


def hamming(spark: SparkSession, n: int) -> Tensor:
    return _raised(spark, n, lambda x: 0.54 - 0.46 * F.cos(TAU * x))


def bartlett(spark: SparkSession, n: int) -> Tensor:
    return _raised(spark, n, lambda x: F.when(x <= 0.5, 2 * x).otherwise(2 - 2 * x))


def blackman(spark: SparkSession, n: int) -> Tensor:
    return _raised(spark, n, lambda x: 0.42 - 0.5 * F.cos(TAU * x) + 0.08 * F.cos(2 * TAU * x))


def kaiser(spark: SparkSession, n: int, beta: float) -> Tensor:
    return fromarray(spark, np.kaiser(n, beta))


def window(spark: SparkSession, name: str, n: int) -> Tensor:
    return {"hanning": hanning, "hamming": hamming, "bartlett": bartlett, "blackman": blackman, "ones": lambda s, m: _raised(s, m, lambda x: F.lit(1.0))}[name](spark, n)


# coordinates: functions of columns


def poltocar(r: Column, theta: Column) -> tuple[Column, Column]:
    return r * F.cos(theta), r * F.sin(theta)


def cartopol(x: Column, y: Column) -> tuple[Column, Column]:
    return F.hypot(x, y), F.atan2(y, x)


def cyltocar(r: Column, theta: Column, z: Column) -> tuple[Column, Column, Column]:
    return (*poltocar(r, theta), z)


def cartocyl(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return (*cartopol(x, y), z)


def sphtocar(r: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    """``theta`` from the pole, ``phi`` around it."""
    return r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)


def cartosph(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    r = F.hypot(F.hypot(x, y), z)
    return r, F.when(r == 0, 0.0).otherwise(F.acos(z / F.when(r == 0, 1.0).otherwise(r))), F.atan2(y, x)


def hoatocar(d: Column, azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Elevation from the horizon."""
    return d * F.cos(elevation) * F.cos(azimuth), d * F.cos(elevation) * F.sin(azimuth), d * F.sin(elevation)


def cartohoa(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return F.hypot(F.hypot(x, y), z), F.atan2(y, x), F.atan2(z, F.hypot(x, y))


def _turn(axis: np.ndarray, angle: float) -> np.ndarray:
    x, y, z = axis / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)


def rotmat(spark: SparkSession, axis: str | tuple[float, float, float], angle: float) -> Tensor:
    """A rotation about x, y, z or any direction."""
    direction = np.eye(3)["xyz".index(axis)] if isinstance(axis, str) else np.array(axis, float)
    return fromarray(spark, _turn(direction, angle))


def rotmatypr(spark: SparkSession, yaw: float, pitch: float, roll: float) -> Tensor:
    x, y, z = np.eye(3)
    return fromarray(spark, _turn(z, yaw) @ _turn(y, -pitch) @ _turn(x, roll))


# ambisonic channels


def nmtoacn(n: Column, m: Column) -> Column:
    return n * n + n + m


def acntonm(acn: Column) -> tuple[Column, Column]:
    n = reals.floor(F.sqrt(acn))
    return n, acn - n * n - n


def hoaordtochnls(n: Column) -> Column:
    return (n + 1) * (n + 1)


def chnlstohoaord(c: Column) -> Column:
    root = F.sqrt(c)
    return F.when(root == reals.floor(root), root - 1).otherwise(F.raise_error(F.lit("not the channels of a complete set")).cast("double"))


def sn3dton3d(acn: Column) -> Column:
    return F.sqrt(2 * acntonm(acn)[0] + 1)


def n3dtosn3d(acn: Column) -> Column:
    return 1 / sn3dton3d(acn)


def legendre(x: Column, n: int, m: int) -> Column:
    """The associated function of degree n and order m, without the sign (-1)^m, by its recurrence."""
    if not 0 <= m <= n:
        raise ValueError(f"degree {n}, order {m}")
    odd = math.prod(range(1, 2 * m, 2))
    before, now = F.lit(0.0), odd * F.pow(F.greatest(F.lit(0.0), 1 - x * x), F.lit(m / 2))
    for k in range(m + 1, n + 1):
        before, now = now, ((2 * k - 1) * x * now - (k + m - 1) * before) / (k - m)
    return now


def sphharm(n: int, m: int, azimuth: Column, elevation: Column) -> Column:
    """One real spherical harmonic, SN3D, by a recurrence that carries the factor.

    The cosine of the elevation keeps its sign, so an elevation past the pole is the direction on the other side.
    """
    a = abs(m)
    if a > n:
        raise ValueError(f"degree {n}, order {m}")
    up, out = F.sin(elevation), F.cos(elevation)
    before, now = F.lit(0.0), F.lit(1.0)
    for k in range(1, a + 1):
        now = now * out * (math.sqrt((2 * k - 1) / (2 * k)) if k > 1 else 1.0)
    for k in range(a + 1, n + 1):
        before, now = now, ((2 * k - 1) * up * now - math.sqrt((k - 1) ** 2 - a * a) * before) / math.sqrt(k * k - a * a) if k > a + 1 else math.sqrt(2 * a + 1) * up * now
    return now * (F.cos(a * azimuth) if m >= 0 else F.sin(a * azimuth))


def sphharmacn(directions: Tensor, order: int) -> Tensor:
    """Every harmonic up to an order (channel x direction) at directions (n x 2: azimuth, elevation)."""
    both = directions.df.groupBy(F.col("i0").alias("i1")).agg(*(F.max(F.when(F.col("i1") == k, F.col("v"))).alias(c) for k, c in enumerate(("az", "el"))))
    values = [sphharm(n, m, F.col("az"), F.col("el")) for n in range(order + 1) for m in range(-n, n + 1)]
    cells = both.select("i1", F.posexplode(F.array(*values)).alias("i0", "v")).select(F.col("i0").cast("long").alias("i0"), "i1", "v")
    return Tensor(cells, 2, (), ((order + 1) ** 2, directions.shape[0]))


# rooms

#: Sabine's constant, and the speed of sound in m/s.
SABINE, SOUND = 0.161, 343.0


def t60sab(volume: Column, absorption: Column) -> Column:
    """``absorption``: the sum of surfaces times their coefficients."""
    return SABINE * volume / absorption


def t60eyr(volume: Column, surface: Column, absorption: Column) -> Column:
    return SABINE * volume / (-surface * reals.ln(1 - absorption / surface))


def rt60absp(volume: Column, t60: Column) -> Column:
    return SABINE * volume / t60


def fschrd(volume: Column, t60: Column) -> Column:
    return 2000 * F.sqrt(t60 / volume)


def fpqr(lx: Column, ly: Column, lz: Column, p: int, q: int, r: int) -> Column:
    square = lambda k, side: (k / side) * (k / side)
    return SOUND / 2 * F.sqrt(square(p, lx) + square(q, ly) + square(r, lz))


def t60tofbg(delay: Column, t60: Column) -> Column:
    return F.pow(F.lit(10.0), -3 * delay / t60)


def fbgtot60(delay: Column, gain: Column) -> Column:
    return F.when((gain > 0) & (gain < 1), -3 * delay / F.log10(F.when(gain > 0, gain))).otherwise(0.0)


def every_pair(a: Tensor, b: Tensor, f) -> Tensor:
    """``f`` of each value of one vector with each of another (a x b)."""
    a.need(REAL)
    column = a.cells(a.df.select(*a.keys, "i0", F.lit(0).cast("long").alias("i1"), "v"), 2, (a.shape[0], 1))
    return zipped(column, b, f)
