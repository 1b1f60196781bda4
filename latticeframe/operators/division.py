"""Inverses of full convolutions: power series by Newton's doubling, lanes and narrow arrays in blocks, others in waves of tiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from ..tensor import COMPLEX, Tensor, matched
from .shape import flatten
from .tiles import written

#: Cells of a series, and growth of its terms up to which it is used: beyond, rounding spreads through transforms, and cells are divided one by one.
SERIES, GROWTH = 1 << 12, 1e4
#: Taps of a kernel up to which products are summed tap by tap.
FEW_TAPS = 32
#: Cells of a tile's side in one, two, three and more dimensions.
SIDES = (1 << 14, 1 << 8, 1 << 5, 1 << 3)
#: Waves from which a narrow array goes by blocks along its longest axis instead; cells that one block hands to the next, and cells of a block.
MOST_WAVES, NARROW, BLOCK = 8, 1 << 10, 1 << 16


def _convolved(a: np.ndarray, b: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The first cells of the full convolution along the last axes of a, as many as b has."""
    axes = tuple(range(-b.ndim, 0))
    full = [n + m - 1 for n, m in zip(a.shape[-b.ndim :], b.shape, strict=True)]
    fast = [1 << max(0, n - 1).bit_length() for n in full]
    if np.iscomplexobj(a) or np.iscomplexobj(b):
        y = np.fft.ifftn(np.fft.fftn(a, fast, axes) * np.fft.fftn(b, fast, axes), axes=axes)
    else:
        with np.errstate(over="ignore", invalid="ignore"):  # terms that grow are told by their size
            y = np.fft.irfftn(np.fft.rfftn(a, fast, axes) * np.fft.rfftn(b, fast, axes), fast, axes)
    y = y[(..., *(slice(0, min(n, m)) for n, m in zip(shape, fast, strict=True)))]
    return np.pad(y, [(0, 0)] * (a.ndim - b.ndim) + [(0, n - m) for n, m in zip(shape, y.shape[a.ndim - b.ndim :], strict=True)])


def series(h: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """The first terms of 1 / h as a power series in as many variables as h has axes.

    Newton's step g (2 - h g) doubles the total degree up to which g is right.
    """
    first = h[(0,) * h.ndim]
    g = np.zeros((1,) * h.ndim, np.result_type(h, float))
    g[...] = 1 / first
    degree, most = 1, sum(n - 1 for n in shape) + 1
    while degree < most and np.isfinite(g).all():
        degree *= 2
        size = tuple(min(n, degree) for n in shape)
        own = h[tuple(slice(0, n) for n in size)]
        g = np.pad(g, [(0, n - m) for n, m in zip(size, g.shape, strict=True)])
        less = -_convolved(own, g, size)
        less[(0,) * h.ndim] += 2
        g = _convolved(g, less, size)
    return g if g.shape == shape and np.isfinite(g).all() else np.full(shape, np.inf)


def _begun(h: np.ndarray) -> np.ndarray:
    if not h.size or h[(0,) * h.ndim] == 0:
        raise ValueError("the kernel begins with 0")
    return h


def _times(x: np.ndarray, h: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """``_convolved``, tap by tap if there are few."""
    if h.size > FEW_TAPS:
        return _convolved(x, h, shape)
    lead = x.shape[: x.ndim - h.ndim]
    out = np.zeros((*lead, *shape), np.result_type(x, h))
    for at in np.argwhere(h != 0).tolist():
        ends = [min(n - i, m) for i, n, m in zip(at, shape, x.shape[len(lead) :], strict=True)]
        out[(..., *(slice(i, i + e) for i, e in zip(at, ends, strict=True)))] += h[tuple(at)] * x[(..., *(slice(0, e) for e in ends))]
    return out


def _steady(h: np.ndarray, g: np.ndarray) -> bool:
    return bool(np.abs(g).max() * np.abs(h[(0,) * h.ndim]) <= GROWTH)


def divider(h: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function of lanes in rows, and of what x before them adds to their first cells (len(h) - 1), that returns x and what it adds beyond.

    Stretches of ``SERIES`` cells, one after the other, are multiplied by the series; a lane's beginning
    is what earlier ones leave. If the series grows, stretches are single cells.
    """
    g, m = series(h, (SERIES,)), len(h) - 1
    size = SERIES if _steady(h, g) else 1

    def run(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = y.shape[1]
        out = np.empty((len(y), n), np.result_type(y, z, h, float))
        z = z.astype(out.dtype)
        for at in range(0, n, size):
            part = y[:, at : at + size].astype(out.dtype)
            w = part.shape[1]
            k = min(w, m)
            part[:, :k] -= z[:, :k]
            x = part / h[0] if size == 1 else _convolved(part, g[:w], (w,))
            out[:, at : at + w] = x
            if m:
                z = np.concatenate([z[:, k:], np.zeros((len(z), k), z.dtype)], axis=1)
                z += _times(x, h, (w + m,))[:, w:]
        return out, z

    return run


def _one_by_one(y: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first cells of y / h, as many as y has."""
    x = np.zeros(y.shape, np.result_type(y, h, float))
    for at in np.ndindex(*y.shape):
        span = [min(i, m - 1) + 1 for i, m in zip(at, h.shape, strict=True)]
        back = x[tuple(slice(i - s + 1, i + 1) for i, s in zip(at, span, strict=True))]
        x[at] = (y[at] - (h[tuple(slice(0, s) for s in span)] * back[(slice(None, None, -1),) * h.ndim]).sum()) / h[(0,) * h.ndim]
    return x


def divided1d(t: Tensor, h: np.ndarray, axis: int | None = None) -> Tensor:
    """x of y = h * x in full along an axis (flat without one).

    A long lane's blocks are divided by different tasks: each from nothing at first, then what goes from
    block to block is carried by a matrix, then each from what it gets.
    """
    from .filters import _along

    if axis is None:
        t, axis = flatten(t) if t.ndim > 1 else t, 0
    h, k = _begun(h), t.axis(axis)
    y, _ = _along(t, divider(h), k, np.zeros(len(h) - 1, np.result_type(h, float)))
    here, less = F.col(f"i{k}"), len(h) - 1
    if not t.keys:
        shape = tuple(max(0, n - less) if j == k else n for j, n in enumerate(t.shape))
        return t.cells(y.df.filter(here < shape[k]), extents=shape)
    # each array's own length
    own = t.df.groupBy(*t.keys).agg((F.max(here) + 1 - less).alias("_n"))
    return t.cells(matched(y.df, own, list(t.keys)).filter(here < F.col("_n")))


@dataclass
class _Blocks:
    """Blocks of whole rows along an array's longest axis, and how what a block gets moves what it adds to the next."""

    h: np.ndarray
    g: np.ndarray
    sides: tuple[int, ...]
    axis: int
    move: np.ndarray | None = None

    @classmethod
    def of(cls, h: np.ndarray, shape: tuple[int, ...]) -> _Blocks | None:
        """For a kernel and the quotient's shape; None if a block hands on too much, or the series grows."""
        axis = max(range(len(shape)), key=shape.__getitem__)
        across, less = math.prod(shape) // shape[axis], h.shape[axis] - 1
        if less * across > NARROW:
            return None
        sides = tuple(max(1, less, BLOCK // across) if k == axis else m for k, m in enumerate(shape))
        h = h[tuple(slice(0, None if k == axis else m) for k, m in enumerate(shape))]
        g = series(h, sides)
        if not _steady(h, g):
            return None
        out = cls(h, g, sides, axis)
        out.move = out._moves()
        return out

    def _along(self, start: int | None, stop: int | None) -> tuple[slice, ...]:
        return tuple(slice(start, stop) if k == self.axis else slice(None) for k in range(len(self.sides)))

    def _handed(self) -> tuple[int, ...]:
        return tuple(self.h.shape[k] - 1 if k == self.axis else m for k, m in enumerate(self.sides))

    def divided(self, y: np.ndarray, z: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A block's quotient and what that adds to the next block's first rows, given what earlier ones add to its own."""
        handed, rows = self._handed(), self.sides[self.axis]
        if z is not None:
            y = y.astype(np.result_type(y, z))
            y[self._along(0, handed[self.axis])] += z.reshape(handed)
        x = _convolved(y, self.g, self.sides)
        longer = tuple(m + handed[k] if k == self.axis else m for k, m in enumerate(self.sides))
        return x, -_times(x, self.h, longer)[self._along(rows, None)]

    def _moves(self) -> np.ndarray:
        """A row for each cell that a block gets. Cells of a row of the array differ by a shift only."""
        handed, nothing = self._handed(), np.zeros(self.sides)
        first = []
        for p in range(handed[self.axis]):
            z = np.zeros(handed)
            z[tuple(p if k == self.axis else 0 for k in range(len(handed)))] = 1
            first.append(self.divided(nothing, z)[1])
        move = np.zeros((math.prod(handed), *handed), np.result_type(self.g, self.h))
        for row, at in enumerate(np.ndindex(*handed)):
            to = tuple(slice(None) if k == self.axis else slice(i, None) for k, i in enumerate(at))
            of = tuple(slice(None) if k == self.axis else slice(0, m - i) for k, (i, m) in enumerate(zip(at, handed, strict=True)))
            move[row][to] = first[at[self.axis]][of]
        return move.reshape(len(move), -1)


def divided(t: Tensor, h: np.ndarray) -> Tensor:
    """x of y = h * x in full along all axes, in waves of tiles, or in blocks of a long narrow array.

    A tile of x is what is left of y's tile, when the products of earlier tiles of x are taken out,
    times the series of 1 / h. Tiles whose numbers add up to the same are a wave: one after the other, waves are
    divided by as many tasks as they have tiles, and leave their x and what it adds to later tiles in
    the shared folder.

    A long narrow array would have a wave for each tile. Its blocks of whole rows are divided from nothing
    at first, to know what each adds to the next; that goes from block to block by a matrix, and blocks
    are divided again, each with what it gets.
    """
    h = _begun(h)
    if t.ndim != h.ndim:
        raise ValueError(f"ranks {t.ndim} and {h.ndim}")
    shape = tuple(max(0, a - b + 1) for a, b in zip(t.shape, h.shape, strict=True))
    if not min(shape):
        return t.cells(t.df.limit(0), extents=shape)
    if t.ndim == 1:
        return divided1d(t, h, 0)
    is_complex = t.kind == COMPLEX or np.iscomplexobj(h)
    dtype, n, keys = complex if is_complex else float, t.ndim, t.keys
    side = SIDES[min(n, len(SIDES)) - 1]
    sides = (side,) * n
    counts = [-(-a // side) for a in shape]
    g = series(h, sides)
    steady = _steady(h, g)
    blocks = _Blocks.of(h, shape) if steady and sum(c - 1 for c in counts) >= MOST_WAVES else None
    if blocks:
        sides, counts = blocks.sides, [-(-a // b) for a, b in zip(shape, blocks.sides, strict=True)]
    reach = [range(-(-(m - 1) // side) + 1) for m in h.shape]  # tiles from one's own on that it adds to
    cells = _cells_of_tiles(t, shape, counts, sides)
    places = [f"b{k}" for k in range(n)]
    schema = StructType([*(cells.schema[c] for c in (*keys, *places)), StructField("wave", LongType()), StructField("done", BooleanType()), StructField("x", BinaryType())])

    def rows(key: tuple, found: list[tuple]) -> pa.Table:
        """Tiles (place, done, cells) of the key's array."""
        own = [pa.array([k.as_py()] * len(found), k.type) for k in key[:-n]]
        at = [pa.array([place[k] for place, _, _ in found], pa.int64()) for k in range(n)]
        rest = pa.array([sum(place) for place, _, _ in found], pa.int64()), pa.array([d for _, d, _ in found]), pa.array([np.ascontiguousarray(x).tobytes() for *_, x in found], pa.binary())
        return pa.Table.from_arrays([*own, *at, *rest], [f.name for f in schema.fields])

    def gathered(key: tuple, table: pa.Table) -> pa.Table:
        x = np.zeros(math.prod(sides), dtype)
        np.add.at(x, table["at"].to_numpy(), table["re"].to_numpy() + (1j * table["im"].to_numpy() if is_complex else 0))
        at = tuple(k.as_py() for k in key[-n:])
        own = [(at, True, blocks.divided(x.reshape(sides))[1])] if blocks else []
        return rows(key, [(at, False, x), *own])

    def carried(key: tuple, table: pa.Table) -> pa.Table:
        """What each of an array's blocks gets, of what each adds to the next from nothing."""
        order = np.argsort(table["wave"].to_numpy())
        z, found = np.zeros(len(blocks.move), dtype), []
        for place, added in zip(table.select(places).take(order).to_pylist(), table["x"].take(order).to_pylist(), strict=True):
            found.append((tuple(place.values()), True, z))
            z = z @ blocks.move + np.frombuffer(added, dtype)
        return rows((*key, *places), found)

    def divide_block(key: tuple, table: pa.Table) -> pa.Table:
        y, z = (np.frombuffer(x, dtype) for _, x in sorted(zip(table["done"].to_pylist(), table["x"].to_pylist(), strict=True), key=lambda row: row[0]))
        return rows(key, [(tuple(k.as_py() for k in key[-n:]), True, blocks.divided(y.reshape(sides), z)[0])])

    def divide(key: tuple, table: pa.Table) -> pa.Table:
        """A tile of y, and what earlier tiles of x take from it, divided; then what that takes from later tiles."""
        at = tuple(k.as_py() for k in key[-n:])
        left = np.sum([np.frombuffer(x, dtype) for x in sorted(table["x"].to_pylist())], axis=0).reshape((side,) * n)
        x = _convolved(left, g, (side,) * n) if steady else _one_by_one(left, h).astype(dtype)
        for k in range(n):  # nothing beyond the array's end
            x[(slice(None),) * k + (slice(max(0, shape[k] - at[k] * side), None),)] = 0
        found, adds = [(at, True, x)], _times(x, h, tuple(side * len(r) for r in reach))
        for step in product(*reach):
            to = tuple(a + b for a, b in zip(at, step, strict=True))
            if any(step) and all(a < c for a, c in zip(to, counts, strict=True)):
                found.append((to, False, -adds[tuple(slice(b * side, (b + 1) * side) for b in step)]))
        return rows(key, found)

    gathering = cells.groupBy(*keys, *places).applyInArrow(gathered, schema)
    if blocks:
        start = written(gathering, "done")
        gets = start.filter("done").groupBy(*keys).applyInArrow(carried, schema)
        found = start.filter("NOT done").unionByName(gets).groupBy(*keys, *places).applyInArrow(divide_block, schema)
    else:
        start = written(gathering, "wave")
        waves: list[DataFrame] = []
        furthest = sum(len(r) - 1 for r in reach)
        for number in range(sum(c - 1 for c in counts) + 1):
            due = start.filter(F.col("wave") == number)
            for earlier in waves[max(0, number - furthest) :]:
                due = due.unionByName(earlier.filter((F.col("wave") == number) & ~F.col("done")))
            waves.append(written(due.groupBy(*keys, *places).applyInArrow(divide, schema), "wave"))
        found = waves[0].filter("done")
        for other in waves[1:]:
            found = found.unionByName(other.filter("done"))
    found = found.select(*keys, *places, "x")
    out = StructType([*(cells.schema[c] for c in keys), *(StructField(f"i{k}", LongType()) for k in range(n)), StructField("re", DoubleType()), StructField("im", DoubleType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = [c[row] for c in batch.columns[: len(keys)]]
                *at, data = (c[row].as_py() for c in batch.columns[len(keys) :])
                x = np.frombuffer(data, dtype).reshape(sides)[tuple(slice(0, a - b * m) for a, b, m in zip(shape, at, sides, strict=True))]
                index = [i.ravel() + b * m for i, b, m in zip(np.indices(x.shape), at, sides, strict=True)]
                parts = [np.ascontiguousarray(f(x).ravel(), float) for f in (np.real, np.imag)]
                yield pa.RecordBatch.from_arrays([*(pa.array([o.as_py()] * x.size, o.type) for o in own), *map(pa.array, index), *map(pa.array, parts)], [f.name for f in out.fields])

    return t.cells(found.mapInArrow(spread, out).withColumn("v", F.struct("re", "im") if is_complex else F.col("re")), extents=shape)


def _cells_of_tiles(t: Tensor, shape: tuple[int, ...], counts: list[int], sides: tuple[int, ...]) -> DataFrame:
    """(keys..., b0, ..., at, re, im): cells by tile and place there, and a zero in each tile of each array, so that none lacks a tile."""
    n = t.ndim
    inside, at = F.lit(True), F.lit(0).cast("long")
    for k in range(n):
        inside = inside & (F.col(f"i{k}") < shape[k])
        at = at * sides[k] + F.pmod(f"i{k}", F.lit(sides[k]))
    value = (F.col("v.re").alias("re"), F.col("v.im").alias("im")) if t.kind == COMPLEX else (F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    cells = t.df.filter(inside).select(*t.keys, *(F.floor(F.col(f"i{k}") / sides[k]).cast("long").alias(f"b{k}") for k in range(n)), at.alias("at"), *value)
    arrays = t.df.select(*t.keys).distinct() if t.keys else t.df.sparkSession.range(1).select()
    every = arrays.select(*t.keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.prod(counts) - 1).cast("long"))).alias("id"))
    stride, tile = 1, []
    for k in reversed(range(n)):
        tile.insert(0, F.pmod(F.floor(F.col("id") / stride), F.lit(counts[k])).cast("long").alias(f"b{k}"))
        stride *= counts[k]
    return cells.unionByName(every.select(*t.keys, *tile, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im")))
