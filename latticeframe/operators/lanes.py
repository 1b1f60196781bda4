"""Running and moving operators along a lane.

A lane is what shares the keys and the other axes. Lanes are cut into blocks, unless they are known
to be short: running sums add the totals of the blocks before, moving windows see the edges of the
neighbouring blocks, so no task holds a long lane.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import complexes, reals
from ..tensor import COMPLEX, REAL, Tensor, matched
from . import medians
from .shape import _reflat, flatten

#: Cells of a block of a lane.
BLOCK = 65_536


def _lane(t: Tensor, axis: int | None) -> tuple[Tensor, list[str], str, tuple[int, ...] | None]:
    """The array (flat without an axis), the lane's columns, its axis, and the shape to restore."""
    shape = None
    if axis is None:
        if t.ndim > 1:
            shape, t = t.shape, flatten(t)
        axis = 0
    k = t.axis(axis)
    return t, [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)], t.axes[k], shape


def _restored(t: Tensor, df: DataFrame, shape: tuple[int, ...] | None) -> Tensor:
    out = t.cells(df, extents=t.extents)
    return out if shape is None else _reflat(out, F.col("i0"), shape)


def _short(t: Tensor, here: str) -> bool:
    return not t.keys and t.ndim > 1 and t.shape[t.axes.index(here)] <= BLOCK


def moving(t: Tensor, left: int, right: int, value: Callable[[Callable, Callable], Column], axis: int | None = None, keep: Column | None = None) -> Tensor:
    """``value(over, at)`` of each cell: ``over`` applies an aggregate to the ``left`` cells before to the ``right`` after, ``at(k)`` is the cell k places on.

    ``keep`` says which cells stay, by the column ``here`` of ``value`` windows; by default all.
    """
    t, others, here, shape = _lane(t, axis)
    rows = t.df.select(*t.places, "v")
    if _short(t, here):
        order = Window.partitionBy(*others).orderBy(here)
        own = F.lit(True)
    else:
        block, place = F.floor(F.col(here) / BLOCK), F.pmod(F.col(here), F.lit(BLOCK))
        first, last = F.floor((F.col(here) - right) / BLOCK), F.floor((F.col(here) + left) / BLOCK)
        # most cells are in no other block's windows and need no list of blocks
        near = F.when((place >= right) & (place < BLOCK - left), F.array(block)).otherwise(F.sequence(first, last))
        rows = rows.withColumn("_b", F.explode(near)).withColumn("_own", F.col("_b") == block)
        order, own = Window.partitionBy(*others, "_b").orderBy(here), F.col("_own")
    frame = order.rowsBetween(-left, right)
    out = rows.withColumn("_v", value(lambda x: x.over(frame), lambda k: (F.lead(F.col("v"), k) if k > 0 else F.lag(F.col("v"), -k)).over(order) if k else F.col("v")))
    out = out.filter(own).filter(F.col("_v").isNotNull()).select(*t.places, F.col("_v").alias("v"))
    return _restored(t, out, shape)


def running(t: Tensor, total: Callable[[Column], Column], both: Callable[[Column, Column], Column], axis: int | None = None) -> Tensor:
    """A running aggregate; ``both`` combines that of what comes before a block with one within the block.

    Totals of blocks are scanned by blocks in their turn, as often as a lane's length asks for, so that
    no window holds more than ``BLOCK`` rows.
    """
    t, others, here, shape = _lane(t, axis)
    rows = t.df.select(*t.places, "v")
    if _short(t, here):
        levels = 1
    else:
        levels, reach = 1, BLOCK
        while reach < t.shape[t.axes.index(here)]:
            levels, reach = levels + 1, reach * BLOCK
    return _restored(t, _scanned(rows, others, here, total, both, max(1, levels), 0), shape)


def _scanned(rows: DataFrame, others: list[str], here: str, total: Callable, both: Callable, levels: int, last: int) -> DataFrame:
    """Rows with the aggregate of v up to the row itself (``last`` 0) or the one before (-1, null at first) along ``here``."""
    block = f"_b{levels}"
    lane = [*others, block]
    rows = rows.withColumn(block, F.floor(F.col(here) / BLOCK))
    window = Window.partitionBy(*lane).orderBy(here).rowsBetween(Window.unboundedPreceding, last)
    within = rows.withColumn("v", total(F.col("v")).over(window))
    if levels == 1:
        return within.drop(block)
    sums = rows.groupBy(*lane).agg(total(F.col("v")).alias("v"))
    before = _scanned(sums, others, block, total, both, levels - 1, -1).withColumnRenamed("v", "_before")
    before = before.filter(F.col("_before").isNotNull())  # short lanes have none
    v = F.when(F.col("_before").isNull(), F.col("v")).when(F.col("v").isNull(), F.col("_before")).otherwise(both(F.col("_before"), F.col("v")))
    return matched(within, before, lane, "left").withColumn("v", v).drop("_before", block)


def _by_parts(t: Tensor, f: Callable[[Tensor], Tensor]) -> Tensor:
    """A real operator on the parts of a complex array."""
    re, im = f(t.map(lambda v: v["re"])), f(t.map(lambda v: v["im"]))
    joined = re.df.join(im.df.withColumnRenamed("v", "_im"), list(re.places))
    return replace(re, df=joined.select(*re.places, complexes.make(F.col("v"), F.col("_im")).alias("v")))


def cumsum(t: Tensor, axis: int | None = None) -> Tensor:
    if t.kind == COMPLEX:
        return _by_parts(t, lambda x: cumsum(x, axis))
    return running(t, F.sum, lambda a, b: a + b, axis)


def cumprod(t: Tensor, axis: int | None = None) -> Tensor:
    if t.kind == COMPLEX:  # magnitudes multiply, angles add
        size = cumprod(t.map(complexes.magnitude), axis)
        angle = cumsum(t.map(lambda v: F.atan2(v["im"], v["re"])), axis)
        joined = size.df.join(angle.df.withColumnRenamed("v", "_a"), list(size.places))
        return replace(size, df=joined.select(*size.places, complexes.make(F.col("v") * F.cos("_a"), F.col("v") * F.sin("_a")).alias("v")))
    return running(t, F.product, lambda a, b: a * b, axis)


def diff(t: Tensor, axis: int = -1) -> Tensor:
    """Each element's difference to the next; the axis gets one shorter."""
    if t.kind == COMPLEX:
        return _by_parts(t, lambda x: diff(x, axis))
    k = t.axis(axis)
    out = moving(replace(t, extents=None), 0, 1, lambda over, at: at(1) - F.col("v"), k)
    return out


def grad(t: Tensor, axis: int | None = None) -> Tensor:
    """Central differences, one-sided at the ends."""
    t.need(REAL)

    def value(over: Callable, at: Callable) -> Column:
        before, after = at(-1), at(1)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)

    return moving(t, 1, 1, value, axis)


def _window(width: int) -> tuple[int, int]:
    if width < 1:
        raise ValueError(f"width {width}")
    return width // 2, width - width // 2 - 1


def movmean(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    if t.kind == COMPLEX:
        return _by_parts(t, lambda x: movmean(x, width, axis))
    return moving(t, *_window(width), lambda over, at: over(F.avg(F.col("v"))), axis)


def movmedian(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    t.need(REAL)
    return medians.sliding(t, *_window(width), medians.window_medians, axis)


def movmin(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    """The smallest of each window, NaN only if there is nothing else."""
    t.need(REAL)
    return moving(t, *_window(width), lambda over, at: over(F.min(F.col("v"))), axis)


def movmax(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    t.need(REAL)
    return moving(t, *_window(width), lambda over, at: F.coalesce(over(F.max(F.when(~F.isnan(F.col("v")), F.col("v")))), F.lit(reals.NAN)), axis)


def _spread(t: Tensor, width: int, axis: int | None, f: Callable[[Column], Column]) -> Tensor:
    if t.kind == COMPLEX:
        total = moving(t, *_window(width), lambda over, at: over(F.var_pop(F.col("v.re"))) + over(F.var_pop(F.col("v.im"))), axis)
        return total.map(f)
    return moving(t, *_window(width), lambda over, at: f(over(F.var_pop(F.col("v")))), axis)


def movvar(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    return _spread(t, width, axis, lambda x: x)


def movstd(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    return _spread(t, width, axis, F.sqrt)


def medfilt1d(t: Tensor, width: int, axis: int | None = None) -> Tensor:
    """Median of each odd window, zeros beyond the ends."""
    t.need(REAL)
    if width % 2 == 0:
        raise ValueError("an even width")
    half = width // 2
    return medians.sliding(t, half, half, lambda x, start, stop: medians.padded_medians(x, start, stop, width), axis)


def medfilt(t: Tensor, *widths: int) -> Tensor:
    """Median over a box of odd widths, zeros beyond the edges."""
    t.need(REAL)
    if len(widths) != t.ndim or any(w % 2 == 0 for w in widths):
        raise ValueError(f"box {widths}")
    return medians.boxes(t, widths)


def unwrap(t: Tensor, period: float, discontinuity: float | None = None, axis: int | None = None) -> Tensor:
    """Takes out jumps of whole periods: each step is wrapped, and the corrections add up along the lane."""
    if t.kind == COMPLEX:
        return _by_parts(t, lambda x: unwrap(x, period, discontinuity, axis))
    limit = period / 2 if discontinuity is None else discontinuity

    def correction(over: Callable, at: Callable) -> Column:
        step = F.col("v") - at(-1)
        wrapped = reals.wrap(step, F.lit(float(period)))
        wrapped = F.when((wrapped == -period / 2) & (step > 0), period / 2).otherwise(wrapped)
        return F.coalesce(F.when(F.abs(step) < limit, 0.0).otherwise(wrapped - step), F.lit(0.0))

    steps = cumsum(moving(t, 1, 0, correction, axis), axis)
    joined = t.df.join(steps.df.withColumnRenamed("v", "_c"), list(t.places))
    return t.cells(joined.withColumn("v", F.col("v") + F.col("_c")), extents=t.extents)


def normalize(t: Tensor, order: float = 1.0, axis: int | None = None) -> Tensor:
    """Divided by the norm of all, or of each lane."""
    from .reductions import norm

    sizes = norm(t, order, axis) if axis is not None else norm(t, order)
    if axis is None:
        rows = t.df.join(sizes.df.withColumnRenamed("v", "_n"), list(t.keys)) if t.keys else t.df.join(F.broadcast(sizes.df.withColumnRenamed("v", "_n")))
    else:
        k = t.axis(axis)
        back = [F.col(f"i{j - (j > k)}").alias(a) for j, a in enumerate(t.axes) if j != k]
        rows = t.df.join(sizes.df.select(*t.keys, *back, F.col("v").alias("_n")), [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)])
    n = F.col("_n")
    scaled = complexes.scale(F.col("v"), 1 / n) if t.kind == COMPLEX else F.col("v") / n
    return t.cells(rows.withColumn("v", scaled), extents=t.extents)


def zcr(t: Tensor, axis: int = -1, threshold: float = 1e-10) -> Tensor:
    """The share of cells whose sign differs from the one before; tiny values count as 0, which is positive."""
    t.need(REAL)
    negative = lambda x: F.when(F.abs(x) <= threshold, False).otherwise(x < 0)
    crossings = moving(t, 1, 0, lambda over, at: F.coalesce((negative(F.col("v")) != negative(at(-1))).cast("double"), F.lit(0.0)), t.axis(axis))
    from .reductions import reduce

    return reduce("mean", crossings, None if t.ndim == 1 else axis)
