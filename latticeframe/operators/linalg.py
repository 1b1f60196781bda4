"""Products, geometry and small dense systems."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexes, reals
from ..tensor import COMPLEX, Tensor
from .creation import generated
from .elementwise import zipped
from .reductions import norm, reduce
from .tiles import Elimination, products

def _side(t: Tensor, name: str, axes: list[str]) -> DataFrame:
    return t.df.select(*t.keys, *(F.col(f"i{k}").alias(a) for k, a in enumerate(axes)), F.col("v").alias(name))


def _sum(a: Tensor, b: Tensor) -> Column:
    """The sum of products of x and y."""
    if COMPLEX not in (a.kind, b.kind):
        return F.sum(F.col("x") * F.col("y"))
    up = lambda v, t: v if t.kind == COMPLEX else complexes.make(v)
    p = complexes.mul(up(F.col("x"), a), up(F.col("y"), b))
    return complexes.make(F.sum(p["re"]), F.sum(p["im"]))


def contract(a: Tensor, b: Tensor, first: list[str], second: list[str], out: list[str]) -> Tensor:
    """Sum of products over ``k``, the axis name that both have and the result hasn't.

    Two matrices are multiplied by tiles. With a vector, where a cell has one partner for each of the
    other's rows, an equi-join on the shared axes is followed by a grouped sum that tasks begin before
    the shuffle.
    """
    sizes = dict(zip(second, b.shape, strict=True)) | dict(zip(first, a.shape, strict=True))
    rows, columns = [n for n in first if n not in second], [n for n in second if n not in first]
    if rows and columns and set(b.keys) <= set(a.keys):
        batch = [n for n in first if n in second and n != "k"]
        left = _side(a, "v", first).withColumnRenamed(rows[-1], "r") if rows[-1] != "r" else _side(a, "v", first)
        right = _side(b, "v", second).withColumnRenamed(columns[-1], "c") if columns[-1] != "c" else _side(b, "v", second)
        own = [k for k in a.keys if k not in b.keys]
        found = products(left, right, [*b.keys, *batch], [*own, *rows[:-1]], columns[:-1], (sizes[rows[-1]], sizes["k"], sizes[columns[-1]]), COMPLEX in (a.kind, b.kind))
        name = {rows[-1]: "r", columns[-1]: "c"}
        return Tensor(found.select(*a.keys, *(F.col(name.get(n, n)).alias(f"i{k}") for k, n in enumerate(out)), "v"), len(out), a.keys, tuple(sizes[n] for n in out))
    shared = [*(k for k in a.keys if k in b.keys), *(n for n in first if n in second)]
    joined = _side(a, "x", first).join(_side(b, "y", second), shared)
    cells = joined.groupBy(*a.keys, *out).agg(_sum(a, b).alias("v"))
    return Tensor(cells.select(*a.keys, *(F.col(n).alias(f"i{k}") for k, n in enumerate(out)), "v"), len(out), a.keys, tuple(sizes[n] for n in out))


def _same(a: int, b: int) -> None:
    if a != b:
        raise ValueError(f"extents {a} and {b} differ")


def dot(a: Tensor, b: Tensor) -> Tensor:
    """Of vectors the scalar product, of matrices the matrix product."""
    if a.ndim == b.ndim == 1:
        _same(a.shape[0], b.shape[0])
        return contract(a, b, ["k"], ["k"], [])
    return matmul(a, b)


def inner(a: Tensor, b: Tensor) -> Tensor:
    """Sum over the last axis of both."""
    _same(a.shape[-1], b.shape[-1])
    first, second = [f"p{k}" for k in range(a.ndim - 1)], [f"q{k}" for k in range(b.ndim - 1)]
    return contract(a, b, [*first, "k"], [*second, "k"], first + second)


def outer(a: Tensor, b: Tensor) -> Tensor:
    """Every product of two vectors' elements; the smaller vector goes to every task."""
    multiply = complexes.mul if COMPLEX in (a.kind, b.kind) else (lambda x, y: x * y)
    joined = _side(a, "x", ["i0"]).crossJoin(_side(b, "y", ["i1"]))
    return Tensor(joined.select("i0", "i1", multiply(F.col("x"), F.col("y")).alias("v")), 2, (), (a.shape[0], b.shape[0]))


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """Matrix product over the last two axes; leading axes are batches, and extents of 1 stand for any."""
    if a.ndim < 2 or b.ndim < 2:
        raise ValueError("matmul is for rank 2 and up")
    _same(a.shape[-1], b.shape[-2])
    n = max(a.ndim, b.ndim) - 2

    def names(t: Tensor, last: list[str]) -> tuple[Tensor, list[str]]:
        batch = [f"b{k}" for k in range(n - (t.ndim - 2), n)]
        single = [k for k in range(t.ndim - 2) if t.shape[k] == 1]
        kept = [F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(k for k in range(t.ndim) if k not in single)]
        small = t.cells(t.df.select(*t.keys, *kept, "v"), t.ndim - len(single), tuple(s for k, s in enumerate(t.shape) if k not in single))
        return small, [x for k, x in enumerate(batch) if k not in single] + last

    a, first = names(a, ["r", "k"])
    b, second = names(b, ["k", "c"])
    out = [f"b{k}" for k in range(n) if f"b{k}" in first + second]
    return contract(a, b, first, second, [*out, "r", "c"])


def trace(t: Tensor) -> Tensor:
    return reduce("sum", t.cells(t.df.filter(F.col("i0") == F.col("i1"))))


def diag(t: Tensor) -> Tensor:
    """A matrix's diagonal, or the matrix of a diagonal."""
    if t.ndim == 2:
        return t.cells(t.df.filter(F.col("i0") == F.col("i1")), 1, (min(t.shape),))
    n = t.shape[0]
    zero = F.lit(0.0) if t.kind != COMPLEX else complexes.make(0.0)
    grid = generated(t.df.sparkSession, (n, n), lambda i, j: F.lit(0.0)).df.drop("v")
    own = t.df.select(F.col("i0").alias("d"), "v")
    cells = grid.join(own, (F.col("i0") == F.col("d")) & (F.col("i1") == F.col("d")), "left")
    return Tensor(cells.select("i0", "i1", F.coalesce("v", zero).alias("v")), 2, (), (n, n))


def cross(a: Tensor, b: Tensor) -> Tensor:
    """Of two vectors of three elements."""
    _same(a.shape[0], 3)
    _same(b.shape[0], 3)
    three = lambda t, n: t.df.groupBy(*t.keys).agg(*(F.sum(F.when(F.col("i0") == k, F.col("v"))).alias(f"{n}{k}") for k in range(3)))
    both = three(a, "x").join(three(b, "y"), list(a.keys)) if a.keys else three(a, "x").crossJoin(three(b, "y"))
    c = F.col
    cells = F.array(c("x1") * c("y2") - c("x2") * c("y1"), c("x2") * c("y0") - c("x0") * c("y2"), c("x0") * c("y1") - c("x1") * c("y0"))
    return a.cells(both.select(*a.keys, F.posexplode(cells).alias("i0", "v")), 1, (3,))


def pairdist(a: Tensor, b: Tensor) -> Tensor:
    if COMPLEX in (a.kind, b.kind):
        return zipped(a, b, lambda x, y: complexes.magnitude(complexes.subtract(x, y)), broadcast=False)
    return zipped(a, b, lambda x, y: F.abs(x - y), broadcast=False)


def dist(a: Tensor, b: Tensor, order: float = 2.0) -> Tensor:
    """Minkowski distance."""
    return norm(pairdist(a, b), order)


def _products(a: Tensor, b: Tensor) -> DataFrame:
    """One row: the sums of x*x, x*y and y*y (of complex ones the real part of x times y's conjugate)."""
    if COMPLEX in (a.kind, b.kind):
        both = zipped(a, b, lambda x, y: F.struct(x["re"] * x["re"] + x["im"] * x["im"], x["re"] * y["re"] + x["im"] * y["im"], y["re"] * y["re"] + y["im"] * y["im"]), broadcast=False)
    else:
        both = zipped(a, b, lambda x, y: F.struct(x * x, x * y, y * y), broadcast=False)
    return both.df.groupBy(*both.keys).agg(*(F.sum(F.col("v")[c]).alias(n) for c, n in (("col1", "xx"), ("col2", "xy"), ("col3", "yy"))))


def angledist(a: Tensor, b: Tensor) -> Tensor:
    """The angle between two vectors."""
    p = _products(a, b)
    cosine = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    return Tensor(p.select(*a.keys, F.acos(reals.clip(cosine, F.lit(-1.0), F.lit(1.0))).alias("v")), 0, a.keys, ())


def _along(a: Tensor, b: Tensor, f) -> Tensor:
    share = _products(a, b).select(*a.keys, (F.col("xy") / F.col("yy")).alias("_s"))
    both = zipped(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")), broadcast=False)
    rows = both.df.join(share, list(a.keys)) if a.keys else both.df.join(F.broadcast(share))
    return both.cells(rows.withColumn("v", f(F.col("v.x"), F.col("v.y"), F.col("_s"))), extents=both.extents)


def project(a: Tensor, b: Tensor) -> Tensor:
    """The part of ``a`` along ``b``."""
    return _along(a, b, lambda x, y, s: s * y)


def reject(a: Tensor, b: Tensor) -> Tensor:
    """The part of ``a`` across ``b``."""
    return _along(a, b, lambda x, y, s: x - s * y)


def reflect(a: Tensor, b: Tensor) -> Tensor:
    """``a`` less twice its part along ``b``."""
    return _along(a, b, lambda x, y, s: x - 2 * s * y)


def hilbertmat(spark: SparkSession, n: int) -> Tensor:
    return generated(spark, (n, n), lambda i, j: 1 / (i + j + 1).cast("double"))


# dense systems: one matrix is eliminated by tiles; of many, one for each key, each is a lane of its cells, and a task takes many at once


def _eliminated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Determinants of matrices, and whether a pivot falls below the rounding of the largest entry."""
    a, n, every = a.copy(), a.shape[1], np.arange(len(a))
    det, singular = np.ones(len(a)), np.zeros(len(a), bool)
    least = n * np.finfo(float).eps * np.abs(a).max(axis=(1, 2), initial=0.0)
    for k in range(n):
        p = k + np.abs(a[:, k:, k]).argmax(axis=1)
        row = a[every, p].copy()
        a[every, p] = a[:, k]
        a[:, k] = row
        singular |= np.abs(a[:, k, k]) <= least
        det *= np.where(p == k, 1.0, -1.0) * a[:, k, k]
        pivot = np.where(singular, 1.0, a[:, k, k])
        a[:, k + 1 :] -= (a[:, k + 1 :, k] / pivot[:, None])[:, :, None] * a[:, k][:, None]
    return np.where(singular, 0.0, det), singular


def _square(t: Tensor) -> int:
    if t.ndim != 2 or t.shape[0] != t.shape[1]:
        raise ValueError(f"shape {t.shape} isn't square")
    return t.shape[0]


def _matrices(t: Tensor, rows: int, columns: int, f, out: int) -> Tensor:
    """``f`` of all matrices (matrix x row x column), whose results have ``out`` cells, as lanes."""
    from .convolution import _lanes

    at = (F.col("i0") * columns + F.col("i1")).alias("i0")
    lanes = Tensor(t.df.select(*t.keys, at, "v"), 1, t.keys, (rows * columns,))

    def run(x: np.ndarray) -> np.ndarray:
        whole = np.pad(x, ((0, 0), (0, rows * columns - x.shape[1])))
        return f(whole.reshape(-1, rows, columns)).reshape(len(x), -1)

    return _lanes(lanes, 0, run, False, out)


def _regular(a: np.ndarray) -> np.ndarray:
    if _eliminated(a)[1].any():
        raise ValueError("a matrix is singular")
    return a


def det(t: Tensor) -> Tensor:
    """Exactly 0 of a singular matrix."""
    n = _square(t)
    if not t.keys:
        own = Elimination(t)
        return Tensor(t.df.sparkSession.createDataFrame([(own.determinant() if own.run() else 0.0,)], "v double"), 0, (), ())
    found = _matrices(t, n, n, lambda a: _eliminated(a)[0], 1)
    return Tensor(found.df.select(*t.keys, "v"), 0, t.keys, ())


def _solved(a: Tensor, right: DataFrame, columns: int) -> DataFrame:
    own = Elimination(a, right, columns)
    if not own.run():
        raise ValueError("a matrix is singular")
    return own.solution()


def inv(t: Tensor) -> Tensor:
    n = _square(t)
    if not t.keys:
        return t.cells(_solved(t, t.df.sparkSession.range(n).select(F.col("id").alias("i0"), F.col("id").alias("i1"), F.lit(1.0).alias("v")), n), 2, (n, n))
    found = _matrices(t, n, n, lambda a: np.linalg.inv(_regular(a)), n * n)
    return t.cells(_indexed(found, (n, n)), 2, (n, n))


def _indexed(lanes: Tensor, shape: tuple[int, int]) -> DataFrame:
    columns = max(1, shape[1])
    return lanes.df.select(*lanes.keys, F.floor(F.col("i0") / columns).alias("i0"), F.pmod(F.col("i0"), F.lit(columns)).alias("i1"), "v")


def solve(a: Tensor, b: Tensor) -> Tensor:
    """x of a x = b, for one or many right-hand sides."""
    n = _square(a)
    _same(n, b.shape[0])
    columns = 1 if b.ndim == 1 else b.shape[1]
    if not a.keys and not b.keys:
        cells = _solved(a, b.df.select("i0", (F.col("i1") if b.ndim == 2 else F.lit(0).cast("long")).alias("i1"), "v"), columns)
        return a.cells(cells if b.ndim == 2 else cells.select("i0", "v"), b.ndim, b.shape)
    right = b.df.select(*b.keys, "i0", ((F.col("i1") if b.ndim == 2 else F.lit(0)) + n).cast("long").alias("i1"), "v")
    both = Tensor(a.df.select(*a.keys, "i0", "i1", "v").unionByName(right), 2, a.keys, (n, n + columns))
    found = _matrices(both, n, n + columns, lambda m: np.linalg.solve(_regular(m[:, :, :n]), m[:, :, n:]), n * columns)
    return a.cells(_indexed(found, (n, columns)) if b.ndim == 2 else found.df, b.ndim, b.shape)


def savgol(spark: SparkSession, width: int, degree: int, spacing: float = 1.0) -> Tensor:
    """Smoothing coefficients of a window, one row for each order of derivative."""
    from .creation import fromarray

    if width % 2 == 0 or degree >= width:
        raise ValueError(f"width {width}, degree {degree}")
    x = np.arange(width) - width // 2
    fit = np.linalg.pinv(np.vander(x, degree + 1, increasing=True).astype(float))
    factors = np.cumprod([1.0, *(k / spacing for k in range(1, degree + 1))])
    return fromarray(spark, fit * factors[:, None])
