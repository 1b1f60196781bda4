"""Elementwise operators, with broadcasting by equi-joins on indices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import complexes, reals
from ..tensor import COMPLEX, REAL, STRING, Tensor

Scalar = float | int | complex | str | Column


def literal(x: Scalar) -> Column:
    if isinstance(x, complex):
        return complexes.make(x.real, x.imag)
    return x if isinstance(x, Column) else F.lit(x if isinstance(x, str) else float(x))


def zipped(a: Tensor, b: Tensor, f: Callable[[Column, Column], Column], broadcast: bool = True) -> Tensor:
    """``f`` of the cells of two arrays at the same place; axes of extent 1 stand for any index.

    The join's keys are the axes that both have in full, so equal shapes join cell by cell.
    """
    if a.keys and b.keys and a.keys != b.keys:
        raise ValueError(f"keys {a.keys} and {b.keys}")
    if a.df is b.df and a.ndim == b.ndim:  # the same cells: no join
        return a.map(lambda v: f(v, v))
    n = max(a.ndim, b.ndim)
    one, other = ([1] * (n - t.ndim) + list(t.shape) for t in (a, b))
    if any(x != y and 1 not in (x, y) for x, y in zip(one, other, strict=True)):
        raise ValueError(f"shapes {a.shape} and {b.shape} don't broadcast")
    if not broadcast and a.shape != b.shape:
        raise ValueError(f"shapes {a.shape} and {b.shape} differ")
    keys = [k for k in a.keys if k in b.keys]
    left = a.df.select(*a.keys, *(F.col(f"i{k}").alias(f"a{k + n - a.ndim}") for k in range(a.ndim)), F.col("v").alias("va"))
    right = b.df.select(*(F.col(k).alias(f"b_{k}") for k in b.keys), *(F.col(f"i{k}").alias(f"b{k + n - b.ndim}") for k in range(b.ndim)), F.col("v").alias("vb"))
    both = [k for k in range(n) if one[k] == other[k] and k >= n - min(a.ndim, b.ndim)]
    on = [F.col(k) == F.col(f"b_{k}") for k in keys] + [F.col(f"a{k}") == F.col(f"b{k}") for k in both]
    # without a shared axis one side is a single cell or each is a line across the other: an outer product
    joined = left.join(right, on) if on else left.crossJoin(right)
    index = [(F.col(f"a{k}") if k >= n - a.ndim and one[k] >= other[k] else F.col(f"b{k}")).alias(f"i{k}") for k in range(n)]
    names = a.keys or b.keys
    carried = [F.col(k) if k in a.keys else F.col(f"b_{k}").alias(k) for k in names]
    shape = tuple(0 if 0 in (x, y) else max(x, y) for x, y in zip(one, other, strict=True))
    return Tensor(joined.select(*carried, *index, f(F.col("va"), F.col("vb")).alias("v")), n, names, shape)


def _functions(name: str, x: bool, y: bool) -> Callable[[Column, Column], Column]:
    """The function for real (False) or complex (True) operands; a real one is promoted."""
    if not x and not y:
        return reals.BINARY[name]
    if name not in complexes.BINARY:
        raise TypeError(f"{name} is for real arrays")
    up = lambda v, is_complex: v if is_complex else complexes.make(v)
    return lambda a, b: complexes.BINARY[name](up(a, x), up(b, y))


def binary(name: str, a: Tensor | Scalar, b: Tensor | Scalar) -> Tensor:
    """A named function of two operands, at least one of them an array.

    Division of an array by an array refuses zeros; by a scalar it follows IEEE.
    """
    is_complex = lambda x: x.kind == COMPLEX if isinstance(x, Tensor) else isinstance(x, complex)
    for x in (a, b):
        if isinstance(x, Tensor):
            x.need(REAL, COMPLEX)
    f = _functions(name, is_complex(a), is_complex(b))
    if isinstance(a, Tensor) and isinstance(b, Tensor):
        if name == "div" and not is_complex(a) and not is_complex(b):
            f = reals.strict_div
        return zipped(a, b, f)
    if isinstance(a, Tensor):
        return a.map(lambda v: f(v, literal(b)))
    return b.map(lambda v: f(literal(a), v))


def unary(name: str, t: Tensor) -> Tensor:
    """A named function of each element."""
    if t.kind == COMPLEX:
        if name == "abs":
            return t.map(complexes.magnitude)
        if name not in complexes.UNARY:
            raise TypeError(f"{name} is for real arrays")
        return t.map(complexes.UNARY[name])
    t.need(REAL)
    return t.map((reals.UNARY | reals.TESTS)[name])


def divmod_(a: Tensor, b: Tensor | float) -> tuple[Tensor, Tensor]:
    """Quotient rounded down and remainder with the divisor's sign."""
    if isinstance(b, Tensor):
        return zipped(a, b, reals.divide_floor), zipped(a, b, reals.modulo)
    return a.map(lambda v: reals.divide_floor(v, literal(b))), a.map(lambda v: reals.modulo(v, literal(b)))


def clip(t: Tensor, low: float, high: float) -> Tensor:
    t.need(REAL)
    return t.map(lambda v: reals.clip(v, literal(low), literal(high)))


def foreach(t: Tensor, f: Callable[[Column], Column]) -> Tensor:
    """A function given by the user, of columns (a pandas UDF too), over every element."""
    t.need(REAL)
    return t.map(f)


def wrap(t: Tensor, period: float) -> Tensor:
    if t.kind == COMPLEX:
        return t.map(lambda v: complexes.wrap(v, literal(period)))
    return t.map(lambda v: reals.wrap(v, literal(period)))


def real(t: Tensor) -> Tensor:
    t.need(COMPLEX)
    return t.map(lambda v: v["re"])


def imag(t: Tensor) -> Tensor:
    t.need(COMPLEX)
    return t.map(lambda v: v["im"])


def angle(t: Tensor) -> Tensor:
    t.need(COMPLEX)
    return t.map(complexes.angle)


def conj(t: Tensor) -> Tensor:
    t.need(COMPLEX)
    return t.map(complexes.conj)


def tocomplex(t: Tensor) -> Tensor:
    t.need(REAL)
    return t.map(complexes.make)


def toreal(t: Tensor) -> Tensor:
    return real(t)


def where(mask: Tensor, a: Tensor, b: Tensor) -> Tensor:
    """Cells of ``a`` where the mask isn't 0 (NaN counts as set), of ``b`` elsewhere; all of one shape."""
    for t in (a, b):
        t.need(REAL, STRING)
    if not mask.shape == a.shape == b.shape:
        raise ValueError(f"shapes {mask.shape}, {a.shape} and {b.shape} differ")
    both = zipped(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")), broadcast=False)
    return zipped(mask, both, lambda m, v: F.when(m != 0, v["x"]).otherwise(v["y"]), broadcast=False)


def putmask(t: Tensor, values: Tensor | Scalar, mask: Tensor | None = None) -> Tensor:
    """``values`` where the mask is set, or where the array itself isn't 0."""
    mask = t if mask is None else mask
    if isinstance(values, Tensor):
        return where(mask, values, t)
    return zipped(mask, t, lambda m, v: F.when(m != 0, literal(values)).otherwise(v), broadcast=False)
