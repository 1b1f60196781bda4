"""Aggregates over everything or along an axis, exact, with NaN as in IEEE arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import complexes, reals
from ..tensor import COMPLEX, REAL, Tensor

def _v() -> Column:
    return F.col("v")


def _with_nan(x: Column) -> Column:
    return F.when(F.bool_or(F.isnan(_v())), reals.NAN).otherwise(x)


def _refuse_empty(x: Column) -> Column:
    return F.when(F.count("*") == 0, F.raise_error(F.lit("an empty array has none")).cast("double")).otherwise(x)


REAL_MODES = {
    "sum": lambda: F.coalesce(F.sum(_v()), F.lit(0.0)),
    "prod": lambda: F.coalesce(F.product(_v()), F.lit(1.0)),
    "mean": lambda: _refuse_empty(F.avg(_v())),
    "min": lambda: _refuse_empty(_with_nan(F.min(_v()))),
    "max": lambda: _refuse_empty(F.max(_v())),
    "median": lambda: _refuse_empty(_with_nan(F.percentile(_v(), F.lit(0.5)))),
    "rms": lambda: reals.rms(_v()),
    "std": lambda: F.stddev_pop(_v()),
    "var": lambda: F.var_pop(_v()),
    "all": lambda: F.coalesce(reals.truth(F.bool_and((_v() != 0) | F.isnan(_v()))), F.lit(1.0)),
    "any": lambda: F.coalesce(reals.truth(F.bool_or((_v() != 0) | F.isnan(_v()))), F.lit(0.0)),
    "cntnz": lambda: F.count_if(_v() != 0).cast("double"),
    "cntnan": lambda: F.count_if(F.isnan(_v())).cast("double"),
    "dbsum": lambda: reals.db_sum(_v()),
}
COMPLEX_MODES = {
    "sum": lambda: complexes.make(F.coalesce(F.sum(F.col("v.re")), F.lit(0.0)), F.coalesce(F.sum(F.col("v.im")), F.lit(0.0))),
    "mean": lambda: complexes.make(F.avg(F.col("v.re")), F.avg(F.col("v.im"))),
    "std": lambda: F.sqrt(F.var_pop(F.col("v.re")) + F.var_pop(F.col("v.im"))),
    "var": lambda: F.var_pop(F.col("v.re")) + F.var_pop(F.col("v.im")),
    # in polar form, so that partial products combine before the shuffle
    "prod": lambda: complexes.make(
        F.coalesce(F.product(F.hypot(F.col("v.re"), F.col("v.im"))), F.lit(1.0)) * F.cos(F.coalesce(F.sum(F.atan2(F.col("v.im"), F.col("v.re"))), F.lit(0.0))),
        F.coalesce(F.product(F.hypot(F.col("v.re"), F.col("v.im"))), F.lit(1.0)) * F.sin(F.coalesce(F.sum(F.atan2(F.col("v.im"), F.col("v.re"))), F.lit(0.0))),
    ),
    "all": lambda: F.coalesce(reals.truth(F.bool_and((F.col("v.re") != 0) | (F.col("v.im") != 0))), F.lit(1.0)),
    "any": lambda: F.coalesce(reals.truth(F.bool_or((F.col("v.re") != 0) | (F.col("v.im") != 0))), F.lit(0.0)),
}


def _grouped(t: Tensor, axis: int | None, value: Column) -> Tensor:
    """One value for each key, or for each place of the other axes."""
    if axis is None:
        return Tensor(t.df.groupBy(*t.keys).agg(value.alias("v")), 0, t.keys, ())
    k = t.axis(axis)
    if t.ndim == 1:
        raise ValueError("an array of rank 1 is reduced without an axis")
    rest = [F.col(a).alias(f"i{j - (j > k)}") for j, a in enumerate(t.axes) if j != k]
    shape = None if t.extents is None else tuple(n for j, n in enumerate(t.extents) if j != k)
    return t.cells(t.df.groupBy(*t.keys, *rest).agg(value.alias("v")), t.ndim - 1, shape)


def reduce(name: str, t: Tensor, axis: int | None = None) -> Tensor:
    """sum, prod, mean, min, max, median, rms, std, var (populations), all, any, cntnz, cntnan or dbsum."""
    modes = COMPLEX_MODES if t.kind == COMPLEX else REAL_MODES
    if name not in modes:
        raise TypeError(f"{name} is for real arrays")
    if name == "median":
        return quantile(t, 0.5, axis)
    return _grouped(t, axis, modes[name]())


def reduce_many(names: list[str], t: Tensor, axis: int | None = None):
    """Several reductions of a real array in one pass: a DataFrame with a column for each."""
    t.need(REAL)
    others = [] if axis is None else [a for j, a in enumerate(t.axes) if j != t.axis(axis)]
    return t.df.groupBy(*t.keys, *others).agg(*(REAL_MODES[n]().alias(n) for n in names))


def sub(t: Tensor, axis: int | None = None) -> Tensor:
    """The first element less all others."""
    if t.kind == COMPLEX:
        at = t.flat() if axis is None else F.col(t.axes[t.axis(axis)])
        return _grouped(t, axis, complexes.make(*(2 * F.min_by(f"v.{c}", at) - F.sum(f"v.{c}") for c in ("re", "im"))))
    t.need(REAL)
    at = t.flat() if axis is None else F.col(t.axes[t.axis(axis)])
    return _grouped(t, axis, 2 * F.min_by(_v(), at) - F.sum(_v()))


def cnteq(t: Tensor, value: float, axis: int | None = None) -> Tensor:
    return _grouped(t, axis, F.count_if((_v() == float(value)) & ~F.isnan(_v())).cast("double"))


def quantile(t: Tensor, q: float, axis: int | None = None) -> Tensor:
    """Exact, linear between neighbours."""
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q}")
    t.need(REAL)
    if axis is None:
        from .sorting import has_large_key, selected

        if t.keys and not has_large_key(t.df, t.keys):
            return _grouped(t, axis, _refuse_empty(_with_nan(F.percentile(_v(), F.lit(float(q))))))
        return Tensor(selected(t.df.select(*t.keys, F.col("v").cast("double").alias("v")), q, t.keys), 0, t.keys, ())
    return _grouped(t, axis, _refuse_empty(_with_nan(F.percentile(_v(), F.lit(float(q))))))


def percentile(t: Tensor, p: float, axis: int | None = None) -> Tensor:
    return quantile(t, p / 100, axis)


def _extreme(t: Tensor, axis: int | None, largest: bool) -> Tensor:
    t.need(REAL)
    at = t.flat() if axis is None else F.col(t.axes[t.axis(axis)])
    # the first NaN wins, else the first extreme
    nan = F.isnan(_v())
    order = F.struct((~nan).alias("a"), F.when(nan, 0.0).otherwise(-_v() if largest else _v()).alias("b"), at.alias("c"))
    if axis is not None:
        return _grouped(t, axis, F.min_by(F.col(t.axes[t.axis(axis)]).cast("double"), order))
    found = t.df.groupBy(*t.keys).agg(F.min_by(F.struct(*t.axes), order).alias("p"))
    cells = found.select(*t.keys, F.posexplode(F.array(*(F.col(f"p.{a}").cast("double") for a in t.axes))).alias("i0", "v"))
    return t.cells(cells, 1, (t.ndim,))


def argmin(t: Tensor, axis: int | None = None) -> Tensor:
    """Coordinates of the smallest element, or its indices along an axis."""
    return _extreme(t, axis, False)


def argmax(t: Tensor, axis: int | None = None) -> Tensor:
    return _extreme(t, axis, True)


def norm(t: Tensor, order: float = 1.0, axis: int | None = None) -> Tensor:
    if order < 1:
        raise ValueError(f"order {order}")
    size = complexes.magnitude(_v()) if t.kind == COMPLEX else F.abs(_v())
    total = F.max(size) if order == float("inf") else F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1.0 / order))
    return _grouped(t, axis, total)


def strjoin(t: Tensor, separator: str = "") -> Tensor:
    """All strings of an array in row-major order as one."""
    cells = F.array_sort(F.collect_list(F.struct(t.flat().alias("at"), "v")))
    return Tensor(t.df.groupBy(*t.keys).agg(F.array_join(F.transform(cells, lambda c: c["v"]), separator).alias("v")), 0, t.keys, ())
