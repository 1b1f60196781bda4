"""Medians of moving windows and boxes, whose cost doesn't grow with the window's width.

Along lanes, all windows of a stretch of cells descend together through a table of its ranks, bit by
bit. In boxes, counts of ranks run along a tile's last axis: cells that leave are taken out, cells that
come are put in.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..tensor import Tensor


class Ranks:
    """Cells of a sequence by rank (NaN last): at each bit of the ranks, how many cells before have it clear."""

    def __init__(self, x: np.ndarray):
        self.sorted = np.sort(x)
        rank = np.empty(len(x), np.int64)
        rank[np.argsort(x, kind="stable")] = np.arange(len(x))
        self.levels = []
        for bit in range(max(1, (len(x) - 1).bit_length()) - 1, -1, -1):
            clear = rank >> bit & 1 == 0
            before = np.concatenate([[0], np.cumsum(clear)]).astype(np.int32)
            self.levels.append((bit, before))
            rank = np.concatenate([rank[clear], rank[~clear]])

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of each window of cells."""
        a, b, k, rank = start.copy(), stop.copy(), k.copy(), np.zeros(len(k), np.int64)
        for bit, before in self.levels:
            low, high = before[a], before[b]
            up = k >= high - low
            k -= np.where(up, high - low, 0)
            rank |= up.astype(np.int64) << bit
            a, b = np.where(up, before[-1] + a - low, low), np.where(up, before[-1] + b - high, high)
        return self.sorted[rank]


def window_medians(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The median of each window, NaN if it holds one."""
    ranks, count = Ranks(x), stop - start
    odd = np.concatenate([[0], np.cumsum(np.isnan(x))])
    with np.errstate(invalid="ignore"):
        middle = (ranks.kth(start, stop, (count - 1) // 2) + ranks.kth(start, stop, count // 2)) / 2
    return np.where(odd[stop] > odd[start], np.nan, middle)


def padded_medians(x: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """The median of each window with zeros up to an odd width; NaN is larger than any number."""
    ranks, zeros, half = Ranks(x), width - (stop - start), width // 2
    below = np.concatenate([[0], np.cumsum(x < 0)])
    negative = below[stop] - below[start]
    k = np.where(half < negative, half, half - zeros)
    inside = (half < negative) | (half >= negative + zeros)
    return np.where(inside, ranks.kth(start, stop, np.where(inside, k, 0)), 0.0)


def sliding(t: Tensor, left: int, right: int, f, axis: int | None) -> Tensor:
    """``f`` of (cells, starts, stops) for the windows from ``left`` cells before to ``right`` after each cell of a lane.

    Blocks of a lane see so many cells of their neighbours. A task reads lanes and blocks as a stream,
    and takes many at once: windows end where lanes do.
    """
    from .convolution import lane_stream
    from .lanes import BLOCK, _lane, _restored

    t, others, here, shape = _lane(t, axis)
    block, place = F.floor(F.col(here) / BLOCK), F.pmod(here, F.lit(BLOCK))
    near = F.when((place >= right) & (place < BLOCK - left), F.array(block)).otherwise(F.sequence(F.floor((F.col(here) - right) / BLOCK), F.floor((F.col(here) + left) / BLOCK)))
    rows = t.df.select(*t.places, F.col("v").cast("double").alias("v"), F.explode(near).alias("_b")).withColumn("_own", F.col("_b") == block)
    lane = [*others, "_b"]
    places = t.places
    kept = [rows.schema[c] for c in places]

    def results(table: pa.Table, starts: np.ndarray):
        ends = np.append(starts[1:], len(table))
        x = table["v"].to_numpy()
        own = np.flatnonzero(table["_own"].to_numpy())
        which = np.searchsorted(starts, own, "right") - 1
        v = f(x, np.maximum(own - left, starts[which]), np.minimum(own + right + 1, ends[which]))
        part = table.take(pa.array(own))
        yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in places), pa.array(v)], [*places, "v"])

    dealt = rows.repartition(*lane).sortWithinPartitions(*lane, here)
    out = dealt.mapInArrow(lane_stream(lane, results), StructType([*kept, StructField("v", DoubleType())]))
    return _restored(t, out, shape)


# boxes


#: Cells of a tile, about.
TILE_CELLS = 4096


def box_medians(x: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """The median of each box of odd widths that lies within x; NaN is larger than any number.

    Counts of ranks, in groups of about the root of their number, move along the last axis for all
    places of the other axes at once.
    """
    values = np.sort(x.ravel())
    rank = np.empty(x.size, np.int64)
    rank[np.argsort(x.ravel(), kind="stable")] = np.arange(x.size)
    rank = rank.reshape(x.shape)
    group = max(1, math.isqrt(x.size))
    *lead, width = widths
    lead = tuple(lead)
    # ranks that each place's box gains with a place of the last axis: (places, box of the other axes, last axis)
    seen = np.moveaxis(np.lib.stride_tricks.sliding_window_view(rank, lead, tuple(range(len(lead)))), len(lead), -1) if lead else rank[None]
    outer = seen.shape[: len(lead)]
    seen = seen.reshape(math.prod(outer), math.prod(lead), x.shape[-1])
    rows = np.arange(len(seen))[:, None]
    fine, coarse = np.zeros((len(seen), group * (x.size // group + 1)), np.int16), np.zeros((len(seen), x.size // group + 1), np.int32)
    middle, out = math.prod(widths) // 2, np.empty((len(seen), x.shape[-1] - width + 1))

    def count(column: int, by: int) -> None:
        r = seen[:, :, column]
        fine[rows, r] += by  # a rank is in one column only
        np.add.at(coarse, (np.broadcast_to(rows, r.shape), r // group), by)

    for column in range(x.shape[-1]):
        count(column, 1)
        if column >= width:
            count(column - width, -1)
        if column >= width - 1:
            upto = np.cumsum(coarse, axis=1)
            g = (upto > middle).argmax(axis=1)
            rest = middle - np.where(g > 0, upto[rows[:, 0], g - 1], 0)
            within = np.cumsum(fine.reshape(len(seen), -1, group)[rows[:, 0], g], axis=1)
            out[:, column - width + 1] = values[g * group + (within > rest[:, None]).argmax(axis=1)]
    return out.reshape(*outer, -1)


def boxes(t: Tensor, widths: tuple[int, ...]) -> Tensor:
    """The median of the box around each cell, zeros where there is none.

    Cells go to their tile and to those that lie within half a box; a tile is a group.
    """
    n, keys = t.ndim, t.keys
    side = max(1, round(TILE_CELLS ** (1 / n)))
    halves = [w // 2 for w in widths]
    rows = t.df.select(*t.places, F.col("v").cast("double").alias("v"))
    for k, h in enumerate(halves):
        at = F.col(f"i{k}")
        rows = rows.withColumn(f"b{k}", F.explode(F.sequence(F.floor((at - h) / side), F.floor((at + h) / side))))
    for k, size in enumerate(t.shape):
        rows = rows.filter((F.col(f"b{k}") >= 0) & (F.col(f"b{k}") * side < size))
    places = [f"b{k}" for k in range(n)]
    schema = StructType([*(rows.schema[c] for c in t.places), StructField("v", DoubleType())])

    def medians(key: tuple, table: pa.Table) -> pa.Table:
        first = [k.as_py() * side for k in key[-n:]]
        at = [table[f"i{k}"].to_numpy() - a for k, a in enumerate(first)]
        x = np.zeros([side + 2 * h for h in halves])
        x[tuple(i + h for i, h in zip(at, halves, strict=True))] = table["v"].to_numpy()
        inside = np.flatnonzero(np.all([(i >= 0) & (i < side) for i in at], axis=0))
        v = box_medians(x, widths)[tuple(i[inside] for i in at)] if len(inside) else np.zeros(0)
        own = [pa.array([k.as_py()] * len(inside), k.type) for k in key[:-n]]
        return pa.Table.from_arrays([*own, *(pa.array(i[inside] + a) for i, a in zip(at, first, strict=True)), pa.array(v)], [f.name for f in schema.fields])

    return t.cells(rows.groupBy(*keys, *places).applyInArrow(medians, schema), extents=t.extents)

