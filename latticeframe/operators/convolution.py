"""Convolution and correlation by products of cells and by blocks, interpolation, and streams of lanes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import complexes
from ..tensor import COMPLEX, REAL, Tensor, matched
from .creation import fromarray
from .elementwise import literal
from .shape import flatten, with_sizes

#: What of the result is returned: all of it, as much as the input, or where the kernel lies within.
FULL, SAME, VALID = "full", "same", "valid"


def _bounds(n: int, m: int, mode: str) -> tuple[int, int]:
    """First place and length of a mode's part of the full result."""
    if mode == FULL:
        return 0, n + m - 1
    if mode == SAME:
        return (m - 1) // 2, n
    if mode == VALID:
        return min(n, m) - 1, max(n, m) - min(n, m) + 1
    raise ValueError(f"mode {mode}")


def _span(n: Column, m: int, mode: str) -> tuple[Column, Column]:
    """The same of an extent that is a column."""
    if mode == FULL:
        return F.lit(0), n + (m - 1)
    if mode == SAME:
        return F.lit((m - 1) // 2), n
    return F.least(n, F.lit(m)) - 1, F.greatest(n, F.lit(m)) - F.least(n, F.lit(m)) + 1


def _product(t: Tensor, kernel: Tensor) -> tuple[Column, bool]:
    x, h = F.col("v"), F.col("h")
    if COMPLEX not in (t.kind, kernel.kind):
        return x * h, False
    up = lambda v, k: v if k == COMPLEX else complexes.make(v)
    return complexes.mul(up(x, t.kind), up(h, kernel.kind)), True


def convolve(t: Tensor, kernel: Tensor, mode: str = FULL, _axes: list[int] | None = None) -> Tensor:
    """Convolution with a kernel of the same rank: each product goes to the sum of the two places.

    Of up to ``DIRECT_TAPS`` taps each cell makes its products where it is; sums begin within tasks, so a
    shuffle moves sums. Up to ``SUMMED_TAPS`` taps are summed over blocks of cells, tap by tap; longer
    kernels go by transforms of blocks.
    """
    taps = math.prod(kernel.shape)
    if taps > DIRECT_TAPS:
        return fftconvolve(t, kernel, mode, _axes, taps <= SUMMED_TAPS)
    axes = list(range(t.ndim)) if _axes is None else _axes
    if kernel.ndim != len(axes):
        raise ValueError(f"ranks {t.ndim} and {kernel.ndim}")
    _bounds(0, 0, mode)
    df, own = with_sizes(t)
    spans = {k: _span(own[k], m, mode) for k, m in zip(axes, kernel.shape, strict=True)}
    h = _taps(kernel)
    each = [F.struct(*(F.lit(int(i)).cast("long").alias(f"k{k}") for i, k in zip(at, axes, strict=True)), literal(h[tuple(at)].item()).alias("h")) for at in np.argwhere(np.ones(h.shape))]
    index = [(F.col(f"i{k}") + F.col(f"k{k}") - spans[k][0]).alias(f"i{k}") if k in spans else F.col(f"i{k}") for k in range(t.ndim)]
    value, is_complex = _product(t, kernel)
    rows = df.withColumn("_t", F.explode(F.array(*each))).select("*", "_t.*") if each else df.limit(0).select("*", *(F.lit(0).alias(f"k{k}") for k in axes), F.lit(0.0).alias("h"))
    placed = rows.select(*t.keys, *index, value.alias("v"), *(n.alias(f"_n{k}") for k, (_, n) in spans.items()))
    for k in spans:
        placed = placed.filter((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < F.col(f"_n{k}")))
    total = complexes.make(F.sum("v.re"), F.sum("v.im")) if is_complex else F.sum("v")
    sizes = dict(zip(axes, kernel.shape, strict=True))
    shape = None if t.keys else tuple(_bounds(n, sizes[k], mode)[1] if k in sizes else n for k, n in enumerate(t.shape))
    return t.cells(placed.groupBy(*t.places).agg(total.alias("v")), extents=shape)


def _turned(kernel: Tensor) -> Tensor:
    from .shape import flip

    out = flip(kernel)
    return out.map(complexes.conj) if kernel.kind == COMPLEX else out


def correlate(t: Tensor, kernel: Tensor, mode: str = FULL) -> Tensor:
    """Convolution with the reversed, conjugated kernel."""
    return convolve(t, _turned(kernel), mode)


def convolve1d(t: Tensor, kernel: Tensor, mode: str = FULL, axis: int | None = None) -> Tensor:
    if axis is None:
        t, axis = flatten(t) if t.ndim > 1 else t, 0
    return convolve(t, kernel, mode, [t.axis(axis)])


def correlate1d(t: Tensor, kernel: Tensor, mode: str = FULL, axis: int | None = None) -> Tensor:
    return convolve1d(t, _turned(kernel), mode, axis)


#: Taps whose products each cell makes by itself, and taps that are summed over blocks one by one, at most.
DIRECT_TAPS, SUMMED_TAPS = 16, 1 << 12
#: Cells of a block that is convolved by one transform, and of a kernel for that at most.
FFT_BLOCK = 1 << 13
FFT_KERNEL = 1 << 20


def _by_blocks(t: Tensor, h: np.ndarray, axes: list[int], is_complex: bool, direct: bool = False) -> DataFrame:
    """Cells of the full convolution along some axes: blocks are convolved by transforms or tap by tap, what they overlap in is added."""
    side = 1 << round(math.log2(FFT_BLOCK) / len(axes))
    sides = [min(side, 1 << max(0, t.shape[k] - 1).bit_length()) for k in axes]
    others = [*t.keys, *(a for k, a in enumerate(t.axes) if k not in axes)]
    blocks = [F.floor(F.col(f"i{k}") / b).cast("long").alias(f"b{k}") for k, b in zip(axes, sides, strict=True)]
    local = F.lit(0).cast("long")
    for k, b in zip(axes, sides, strict=True):
        local = local * b + F.pmod(F.col(f"i{k}"), F.lit(b))
    names = [f"b{k}" for k in axes]
    held = [f"_k{a}" for a in others]  # other axes are keys here
    cut = Tensor(t.df.select(*(F.col(a).alias(b) for a, b in zip(others, held, strict=True)), *blocks, local.alias("i0"), "v"), 1, (*held, *names), (math.prod(sides),))
    out = [b + m - 1 for b, m in zip(sides, h.shape, strict=True)]
    fast = [1 << (n - 1).bit_length() for n in out]
    over = tuple(range(1, len(axes) + 1))
    every = tuple(range(h.ndim))
    spectrum = np.fft.fftn(h, fast, every) if is_complex else np.fft.rfftn(h, fast, every)

    def product(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, math.prod(sides) - x.shape[1]))).reshape(-1, *sides)
        y = np.fft.ifftn(np.fft.fftn(x, fast, over) * spectrum, fast, over) if is_complex else np.fft.irfftn(np.fft.rfftn(x, fast, over) * spectrum, fast, over)
        return y[(slice(None), *(slice(0, n) for n in out))].reshape(len(x), -1)

    def summed(x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, math.prod(sides) - x.shape[1]))).reshape(-1, *sides)
        y = np.zeros((len(x), *out), np.result_type(x, h))
        for place in np.ndindex(*h.shape):
            y[(slice(None), *(slice(i, i + b) for i, b in zip(place, sides, strict=True)))] += h[place] * x
        return y.reshape(len(x), -1)

    done = _lanes(cut, 0, summed if direct else product, is_complex, math.prod(out)).df
    at, place = F.col("i0"), {}
    for k, n, b in reversed(list(zip(axes, out, sides, strict=True))):
        place[k] = (F.pmod(at, F.lit(n)) + F.col(f"b{k}") * b).alias(f"i{k}")
        at = F.floor(at / n)
    rows = done.select(*(F.col(b).alias(a) for a, b in zip(others, held, strict=True)), *place.values(), "v").select(*t.places, "v")
    if all(t.shape[k] <= b for k, b in zip(axes, sides, strict=True)):
        return rows
    total = complexes.make(F.sum("v.re"), F.sum("v.im")) if is_complex else F.sum("v")
    return rows.groupBy(*t.places).agg(total.alias("v"))


def fftconvolve(t: Tensor, kernel: Tensor, mode: str = FULL, _axes: list[int] | None = None, _direct: bool = False) -> Tensor:
    """``convolve`` by transforms of blocks, which pays from a dozen taps on; the kernel's spectrum goes to every task."""
    axes = list(range(t.ndim)) if _axes is None else _axes
    if kernel.ndim != len(axes):
        raise ValueError(f"ranks {t.ndim} and {kernel.ndim}")
    if math.prod(kernel.shape) > FFT_KERNEL:
        raise ValueError(f"a kernel of shape {kernel.shape}; at most {FFT_KERNEL} cells")
    full = _by_blocks(t, _taps(kernel), axes, COMPLEX in (t.kind, kernel.kind), _direct)
    if t.keys:
        own = t.df.groupBy(*t.keys).agg(*((F.max(f"i{k}") + 1).alias(f"_n{k}") for k in axes))
        full = matched(full, own, list(t.keys))
    shape, index = list(t.shape), []
    for k, m in zip(axes, kernel.shape, strict=True):
        first, n = _span(F.col(f"_n{k}") if t.keys else F.lit(t.shape[k]), m, mode)
        full = full.withColumn(f"i{k}", F.col(f"i{k}") - first).filter((F.col(f"i{k}") >= 0) & (F.col(f"i{k}") < n))
        shape[k] = _bounds(t.shape[k], m, mode)[1]
    return t.cells(full, extents=None if t.keys else tuple(shape))


def fftcorrelate(t: Tensor, kernel: Tensor, mode: str = FULL) -> Tensor:
    return fftconvolve(t, _turned(kernel), mode)


def fftconvolve1d(t: Tensor, kernel: Tensor, mode: str = FULL, axis: int | None = None) -> Tensor:
    if axis is None:
        t, axis = flatten(t) if t.ndim > 1 else t, 0
    return fftconvolve(t, kernel, mode, [t.axis(axis)])


def fftcorrelate1d(t: Tensor, kernel: Tensor, mode: str = FULL, axis: int | None = None) -> Tensor:
    return fftconvolve1d(t, _turned(kernel), mode, axis)


#: Cells that a task gathers before it hands whole lanes on.
GATHERED = 1 << 16


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows of a sorted table that begin a lane, but the first one."""
    out = np.zeros(max(0, len(table) - 1), bool)
    for c in columns:
        column = table.column(c).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        missing = pc.xor(pc.is_null(a), pc.is_null(b))
        out |= pc.or_(missing, pc.fill_null(pc.not_equal(a, b), False)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(out) + 1


def lane_stream(others: list[str], results: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable:
    """A task over rows sorted by lane (``others``): hands on whole lanes, many at once, with the rows where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the rows so far of the last lane
        fresh: list[pa.Table] = []

        def whole_lanes() -> Iterator[pa.RecordBatch]:
            edge = [held[-1].slice(len(held[-1]) - 1)] if held else []
            cuts = _changes(pa.concat_tables(edge + fresh), others)
            if not len(cuts):
                held.extend(fresh)
                return
            table = pa.concat_tables(held + fresh).combine_chunks()
            cuts += sum(map(len, held)) - len(edge)
            yield from results(table.slice(0, int(cuts[-1])), np.append(0, cuts[:-1]))
            held[:] = [table.slice(int(cuts[-1]))]

        for batch in batches:
            if len(batch):
                fresh.append(pa.Table.from_batches([batch]))
            if sum(map(len, fresh)) >= GATHERED:
                yield from whole_lanes()
                fresh = []
        if fresh:
            yield from whole_lanes()
        if held:
            yield from results(pa.concat_tables(held).combine_chunks(), np.zeros(1, np.int64))

    return run


def _lanes(t: Tensor, axis: int, f, is_complex: bool, n: int | None = None) -> Tensor:
    """``f`` of all lanes at once: a matrix with a lane in each row gives one with a result in each row.

    A lane's length is its own last place plus 1, missing places are 0; lanes of equal length go to
    ``f`` together. Rows are dealt by lane and sorted, and a task reads them as a stream: it holds some
    ``GATHERED`` cells, or one lane that is longer. ``n`` is the results' length, where all have the same.
    """
    k = t.axis(axis)
    others = [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)]
    here = t.axes[k]
    had_complex = t.kind == COMPLEX
    df = t.df.select(*t.places, *((F.col("v.re").alias("re"), F.col("v.im").alias("im")) if had_complex else (F.col("v").cast("double").alias("re"),)))
    dealt = df.repartition(*others) if others else df.repartition(1)
    fields = [x for x in df.schema.fields if x.name in others]
    schema = StructType([*fields, StructField(here, LongType()), StructField("re", DoubleType()), *([StructField("im", DoubleType())] if is_complex else [])])

    def results(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.append(starts[1:], len(table))
        at, x = table.column(here).to_numpy(), table.column("re").to_numpy()
        if had_complex:
            x = x + 1j * table.column("im").to_numpy()
        sizes = at[ends - 1] + 1
        for size in np.unique(sizes):
            mine = np.flatnonzero(sizes == size)
            cells = np.repeat(starts[mine], ends[mine] - starts[mine])
            within = np.arange(len(cells)) - np.repeat(np.cumsum(ends[mine] - starts[mine]) - (ends[mine] - starts[mine]), ends[mine] - starts[mine])
            rows = np.repeat(np.arange(len(mine)), ends[mine] - starts[mine])
            matrix = np.zeros((len(mine), size), x.dtype)
            matrix[rows, at[cells + within]] = x[cells + within]
            y = f(matrix)
            m = y.shape[1]
            first = pa.array(np.repeat(starts[mine], m))
            columns = [table.column(c).take(first).combine_chunks() for c in others]
            parts = [np.real(y).astype(float).ravel()] + ([np.imag(y).astype(float).ravel()] if is_complex else [])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(m), len(mine))), *map(pa.array, parts)], [x.name for x in schema.fields])

    out = dealt.sortWithinPartitions(*others, here).mapInArrow(lane_stream(others, results), schema)
    value = F.struct("re", "im") if is_complex else F.col("re")
    known = None if n is None or t.keys and t.ndim > 1 else (n,) if t.ndim == 1 else tuple(n if j == k else m for j, m in enumerate(t.shape))
    return t.cells(out.withColumn("v", value), extents=known)


def _each(f):
    """A function of one lane's array as one of a matrix with a lane in each row."""
    return lambda x: np.stack([f(row) for row in x])


def _taps(kernel: Tensor) -> np.ndarray:
    """A kernel's values on the driver; kernels are short."""
    from .creation import toarray

    return toarray(kernel)


def deconvolve1d(t: Tensor, kernel: Tensor, axis: int | None = None) -> Tensor:
    """The inverse of a full ``convolve1d``."""
    from .division import divided1d

    return divided1d(t, _taps(kernel), axis)


def decorrelate1d(t: Tensor, kernel: Tensor, axis: int | None = None) -> Tensor:
    return deconvolve1d(t, _turned(kernel), axis)


def _spectral(y: np.ndarray, h: np.ndarray) -> np.ndarray:
    axes = tuple(range(y.ndim))
    spectrum = np.fft.fftn(h, y.shape, axes)
    if np.abs(spectrum).min() <= np.finfo(float).eps * np.abs(spectrum).max():
        raise ValueError("the kernel's spectrum has a zero")
    x = np.fft.ifftn(np.fft.fftn(y) / spectrum)
    x = x[tuple(slice(0, n - m + 1) for n, m in zip(y.shape, h.shape, strict=True))]
    return x if np.iscomplexobj(y) or np.iscomplexobj(h) else x.real


def fftdeconvolve1d(t: Tensor, kernel: Tensor, axis: int | None = None) -> Tensor:
    if axis is None:
        t, axis = flatten(t) if t.ndim > 1 else t, 0
    h = _taps(kernel)
    return _lanes(t, axis, _each(lambda y: _spectral(y, h)), COMPLEX in (t.kind, kernel.kind))


def fftdecorrelate1d(t: Tensor, kernel: Tensor, axis: int | None = None) -> Tensor:
    return fftdeconvolve1d(t, _turned(kernel), axis)


def deconvolve(t: Tensor, kernel: Tensor) -> Tensor:
    """The inverse of a full ``convolve``."""
    from .division import divided

    return divided(t, _taps(kernel))


def decorrelate(t: Tensor, kernel: Tensor) -> Tensor:
    return deconvolve(t, _turned(kernel))


def fftdeconvolve(t: Tensor, kernel: Tensor) -> Tensor:
    """The inverse of a full ``convolve`` by transforms along one axis after the other; the kernel's spectrum is a sum over its taps."""
    h, shape = _taps(kernel), t.shape
    if t.ndim != h.ndim or math.prod(h.shape) > 512:
        raise ValueError(f"a kernel of shape {h.shape}")
    spectrum, every = t, range(t.ndim)
    for k in every:
        spectrum = _lanes(spectrum, k, lambda x, n=shape[k]: np.fft.fft(x, n), True, shape[k])
    re, im = F.lit(0.0), F.lit(0.0)
    for at in np.argwhere(h != 0):
        turn = sum((F.pmod(F.col(f"i{k}") * int(at[k]), F.lit(shape[k])) * F.lit(-2 * math.pi / shape[k]) for k in every), F.lit(0.0))
        x, y = float(np.real(h[tuple(at)])), float(np.imag(h[tuple(at)]))
        re, im = re + x * F.cos(turn) - y * F.sin(turn), im + x * F.sin(turn) + y * F.cos(turn)
    least = float(np.finfo(float).eps * np.abs(h).sum())
    own = complexes.make(F.when(F.hypot(re, im) <= least, F.raise_error(F.lit("the kernel's spectrum has a zero")).cast("double")).otherwise(re), im)
    back = spectrum.cells(spectrum.df.withColumn("v", complexes.div(F.col("v"), own)), extents=shape)
    for k in every:
        back = _lanes(back, k, lambda x, n=shape[k]: np.fft.ifft(x, n), True, shape[k])
    out = tuple(n - m + 1 for n, m in zip(shape, h.shape, strict=True))
    inside = F.lit(True)
    for k in every:
        inside = inside & (F.col(f"i{k}") < out[k])
    cells = t.cells(back.df.filter(inside), extents=out)
    return cells if COMPLEX in (t.kind, kernel.kind) else cells.map(lambda v: v["re"])


def fftdecorrelate(t: Tensor, kernel: Tensor) -> Tensor:
    return fftdeconvolve(t, _turned(kernel))


def amdf(t: Tensor, max_lag: int, axis: int = -1) -> Tensor:
    """The mean absolute difference of cells a lag apart, for lags up to ``max_lag``: each cell meets those before it."""
    t.need(REAL)
    k = t.axis(axis)
    here = t.axes[k]
    others = [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)]
    lags = t.df.sparkSession.range(max_lag + 1).select(F.col("id").alias("lag"))
    shifted = t.df.crossJoin(F.broadcast(lags)).select(*others, (F.col(here) - F.col("lag")).alias(here), "lag", F.col("v").alias("w")).filter(F.col(here) >= 0)
    both = t.df.join(shifted, [*others, here])
    out = both.groupBy(*others, "lag").agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias("v")).withColumn(here, F.col("lag"))
    return t.cells(out, extents=tuple(max_lag + 1 if j == k else n for j, n in enumerate(t.shape)))


# interpolation

MODES = ("linear", "nearest", "previous", "next", "cubic")
BOUNDS = ("clamp", "nan", "extrapolate", "refuse")


def _slope(before2: Column, before: Column, own: Column, after: Column, after2: Column) -> Column:
    """Slope of the monotone cubic at a breakpoint (Fritsch and Butland's harmonic mean), from two neighbours on each side, null where there are none."""
    width = lambda p, q: q["x"] - p["x"]
    rise = lambda p, q: (q["y"] - p["y"]) / width(p, q)

    def end(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return F.when(s * d0 <= 0, 0.0).when((d0 * d1 <= 0) & (F.abs(s) > 3 * F.abs(d0)), 3 * d0).otherwise(s)

    h0, h1, d0, d1 = width(before, own), width(own, after), rise(before, own), rise(own, after)
    a, b = 2 * h1 + h0, h1 + 2 * h0
    return (
        F.when(before.isNull() & after.isNull(), 0.0)
        .when(before.isNull() & after2.isNull(), d1)
        .when(before.isNull(), end(h1, width(after, after2), d1, rise(after, after2)))
        .when(after.isNull() & before2.isNull(), d0)
        .when(after.isNull(), end(h0, width(before2, before), d0, rise(before2, before)))
        .when(d0 * d1 > 0, (a + b) / (a / d0 + b / d1))
        .otherwise(0.0)
    )


def _pieces(points: DataFrame, cubic: bool) -> DataFrame:
    """(x, x1, p) of breakpoints (i0, x, y): p has both ends of the piece that begins at x, and their slopes if they are asked for.

    Neighbours come from windows along blocks of the table.
    """
    from .lanes import moving

    table = Tensor(points.select("i0", F.struct("x", "y").alias("v")), 1)

    def piece(over: Callable, at: Callable) -> Column:
        own, after = F.col("v"), at(1)
        near = [at(k) if k else own for k in range(-2, 4)]
        slopes = (_slope(*near[:5]), _slope(*near[1:])) if cubic else (F.lit(0.0), F.lit(0.0))
        rising = F.when(after["x"] > own["x"], after["x"]).otherwise(F.raise_error(F.lit("breakpoints don't increase")).cast("double"))
        made = F.struct(own["x"].alias("x"), own["y"].alias("y"), slopes[0].alias("s"), rising.alias("x1"), after["y"].alias("y1"), slopes[1].alias("s1"))
        return F.when(after.isNotNull(), made)

    found = moving(table, 2 if cubic else 0, 3 if cubic else 1, piece).df
    return found.select(F.col("v.x").alias("x"), F.col("v.x1").alias("x1"), F.col("v").alias("p"))


def interp(t: Tensor, x: Tensor, y: Tensor, mode: str = "linear", bounds: str = "clamp") -> Tensor:
    """Values mapped through a table of breakpoints, which increase along the table.

    Values and the pieces between breakpoints are dealt by ranges of value; a piece goes to all ranges that
    it reaches into. Within a range each value meets the last piece that begins at or before it, so no
    value is compared with every breakpoint, and neither values nor breakpoints are in one task.
    """
    from .sorting import RANGES, _dealt

    t.need(REAL)
    if mode not in MODES or bounds not in BOUNDS:
        raise ValueError(f"{mode}, {bounds}")
    points = x.df.select("i0", F.col("v").alias("x")).join(y.df.select("i0", F.col("v").alias("y")), "i0")
    n = int(t.df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    ends = x.df.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", [k / n for k in range(1, n)]).alias("q")).first()
    limits = sorted(set(ends.q or []))
    first = _dealt(_pieces(points, mode == "cubic"), limits, F.col("x")).withColumnRenamed("_p", "_from")
    reached = _dealt(first, limits, F.col("x1")).withColumn("_p", F.explode(F.sequence("_from", "_p")))
    starts = reached.select("_p", F.col("x").alias("at"), "p", F.lit(0).alias("_q"))
    inside = F.greatest(F.lit(ends.low), F.least(F.col("v"), F.lit(ends.high)))
    asked = _dealt(t.df.select(*t.places, "v", F.when(F.isnan("v"), F.lit(ends.low)).otherwise(inside).alias("at")), limits, F.col("at"))
    merged = asked.withColumn("_q", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    own = F.last("p", ignorenulls=True).over(Window.partitionBy("_p").orderBy("at", "_q").rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("p", own).filter("_q = 1")
    p, at = F.col("p"), F.col("v") if bounds == "extrapolate" else F.col("at")
    width = p["x1"] - p["x"]
    u = (at - p["x"]) / width
    value = {
        "linear": p["y"] + (p["y1"] - p["y"]) * u,
        "nearest": F.when(at - p["x"] <= p["x1"] - at, p["y"]).otherwise(p["y1"]),
        "previous": F.when(at >= p["x1"], p["y1"]).otherwise(p["y"]),
        "next": F.when(at <= p["x"], p["y"]).otherwise(p["y1"]),
        "cubic": p["y"] * (1 - u) * (1 - u) * (1 + 2 * u) + p["y1"] * u * u * (3 - 2 * u) + width * (p["s"] * u * (1 - u) * (1 - u) - p["s1"] * u * u * (1 - u)),
    }[mode]
    outside = (F.col("v") < ends.low) | (F.col("v") > ends.high)
    if bounds == "nan":
        value = F.when(outside, float("nan")).otherwise(value)
    if bounds == "refuse":
        value = F.when(outside, F.raise_error(F.lit("a value is outside the table")).cast("double")).otherwise(value)
    value = F.when(F.isnan("v"), float("nan")).otherwise(value)
    return t.cells(found.withColumn("v", value), extents=t.extents)


def resample(t: Tensor, n: int, mode: str = "linear") -> Tensor:
    """A vector at ``n`` places spread evenly from its first to its last."""
    m = t.shape[0]
    places = t.df.sparkSession.range(n).select(F.col("id").alias("i0"), (F.col("id") * F.lit((m - 1) / max(1, n - 1))).alias("v"))
    return interp(Tensor(places, 1, (), (n,)), t.map(lambda v: v).cells(t.df.withColumn("v", F.col("i0").cast("double"))), t, mode)


def lagrange(x: Tensor, y: Tensor) -> Tensor:
    """Coefficients of the polynomial through a few points, the highest degree first."""
    a, b = _taps(x), _taps(y)
    total = np.zeros(len(a))
    for k in range(len(a)):
        rest = np.delete(a, k)
        total += b[k] * np.poly(rest) / np.prod(a[k] - rest)
    return fromarray(x.df.sparkSession, total)


def roots(t: Tensor, axis: int | None = None) -> Tensor:
    """The roots of each lane's polynomial, the highest degree first, as complex numbers in no order."""
    from .polynomials import all_roots

    if axis is None:
        t, axis = flatten(t) if t.ndim > 1 else t, 0
    return _lanes(t, axis, all_roots, True)


