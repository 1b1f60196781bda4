"""Shape and layout: new index columns over the same cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexes
from ..tensor import COMPLEX, REAL, STRING, Tensor, matched
from .creation import indexed
from .elementwise import literal


def _zero(t: Tensor) -> Column:
    return {REAL: F.lit(0.0), COMPLEX: complexes.make(0.0), STRING: F.lit("")}[t.kind]


def _index(t: Tensor, **changed: Column) -> Tensor:
    """The array with some index columns computed anew."""
    return t.cells(t.df.select(*t.keys, *(changed.get(a, F.col(a)).alias(a) for a in t.axes), "v"))


def _reflat(t: Tensor, flat: Column, shape: Sequence[int]) -> Tensor:
    df = indexed(t.df.select(*t.keys, flat.alias("id"), "v"), F.col("id"), shape)
    return t.cells(df, len(shape), tuple(shape))


def with_sizes(t: Tensor) -> tuple[DataFrame, list[Column]]:
    """Cells, and each axis's extent: a number, or with keys that of the cell's own array, by a join with grouped maxima."""
    if not t.keys:
        return t.df, [F.lit(n) for n in t.shape]
    names = [f"_n{k}" for k in range(t.ndim)]
    own = t.df.groupBy(*t.keys).agg(*((F.max(a) + 1).alias(n) for a, n in zip(t.axes, names, strict=True)))
    return matched(t.df.select(*t.places, "v"), own, list(t.keys)), [F.col(n) for n in names]


def _flat(t: Tensor, own: list[Column]) -> Column:
    """A cell's place in row-major order of its own array."""
    at = F.lit(0).cast("long")
    for a, n in zip(t.axes, own, strict=True):
        at = at * n + F.col(a)
    return at


def _unflat(flat: Column, own: list[Column]) -> list[Column]:
    out = []
    for k in reversed(range(len(own))):
        out.append((F.pmod(flat, F.greatest(own[k], F.lit(1))) if k else flat).cast("long").alias(f"i{k}"))
        flat = F.floor(flat / F.greatest(own[k], F.lit(1)))
    return out[::-1]


def _moved(t: Tensor, index) -> Tensor:
    """The array with new places: ``index`` of the own extents gives a column for each axis."""
    df, own = with_sizes(t)
    return t.cells(df.select(*t.keys, *index(own), "v"), extents=None if t.keys else t.shape)


def reshape(t: Tensor, *shape: int) -> Tensor:
    if math.prod(shape) != math.prod(t.shape):
        raise ValueError(f"{t.shape} can't be {shape}")
    return _reflat(t, t.flat(), shape)


def flatten(t: Tensor) -> Tensor:
    if t.keys:
        df, own = with_sizes(t)
        return t.cells(df.select(*t.keys, _flat(t, own).alias("i0"), "v"), 1)
    return _reflat(t, t.flat(), (math.prod(t.shape),))


def transpose(t: Tensor, *axes: int) -> Tensor:
    """Axes in another order, by default reversed."""
    order = [t.axis(a) for a in axes] if axes else list(reversed(range(t.ndim)))
    if sorted(order) != list(range(t.ndim)):
        raise ValueError(f"axes {axes}")
    moved = t.df.select(*t.keys, *(F.col(f"i{old}").alias(f"i{new}") for new, old in enumerate(order)), "v")
    return t.cells(moved, extents=tuple(t.shape[k] for k in order))


def flip(t: Tensor, axis: int | None = None) -> Tensor:
    """Reverses one axis, or every axis. Like all that follows, it uses the extents of each key's own array."""
    which = range(t.ndim) if axis is None else [t.axis(axis)]
    return _moved(t, lambda own: [(own[k] - 1 - F.col(a) if k in which else F.col(a)).alias(a) for k, a in enumerate(t.axes)])


def roll(t: Tensor, shift: int, axis: int | None = None) -> Tensor:
    if axis is None:
        return _moved(t, lambda own: _unflat(F.pmod(_flat(t, own) + shift, math.prod(own[1:], start=own[0])), own))
    k = t.axis(axis)
    return _moved(t, lambda own: [(F.pmod(F.col(a) + shift, own[k]) if j == k else F.col(a)).alias(a) for j, a in enumerate(t.axes)])


def reverse(t: Tensor) -> Tensor:
    return _moved(t, lambda own: _unflat(math.prod(own[1:], start=own[0]) - 1 - _flat(t, own), own))


def pad(t: Tensor, before: int, after: int, value=0.0, axis: int | None = None) -> Tensor:
    """Cells of ``value`` before and after along one axis, or every axis. The new cells are generated, none is copied."""
    which = list(range(t.ndim)) if axis is None else [t.axis(axis)]
    moved = t.df.select(*t.keys, *((F.col(a) + (before if k in which else 0)).alias(a) for k, a in enumerate(t.axes)), "v")
    grown = lambda own: [n + (before + after if k in which else 0) for k, n in enumerate(own)]
    if t.keys:
        arrays = t.df.groupBy(*t.keys).agg(*((F.max(a) + 1).alias(f"_n{k}") for k, a in enumerate(t.axes)))
        own = [F.col(f"_n{k}") for k in range(t.ndim)]
        count = math.prod(grown(own)[1:], start=grown(own)[0])
        spread = arrays.select("*", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("id"))
        new = spread.select(*t.keys, *_unflat(F.col("id"), grown(own)), *(n.alias(f"_n{k}") for k, n in enumerate(own)))
        shape = None
    else:
        own, shape = [F.lit(n) for n in t.shape], tuple(grown(t.shape))
        new = indexed(t.df.sparkSession.range(math.prod(shape)), F.col("id"), shape)
    border = F.lit(False)
    for k in which:
        border = border | (F.col(f"i{k}") < before) | (F.col(f"i{k}") >= before + own[k])
    new = new.filter(border).select(*t.places, literal(complex(value) if t.kind == COMPLEX else value).alias("v"))
    return t.cells(moved.unionByName(new), extents=shape)


def truncate(t: Tensor, n: int, axis: int | None = None) -> Tensor:
    which = range(t.ndim) if axis is None else [t.axis(axis)]
    keep = F.lit(True)
    for k in which:
        keep = keep & (F.col(f"i{k}") < n)
    return t.cells(t.df.filter(keep))


def head(t: Tensor, n: int) -> Tensor:
    if t.ndim != 1:
        raise ValueError("head is for arrays of rank 1")
    return truncate(t, n, 0)


def resize(t: Tensor, *shape: int) -> Tensor:
    """Another size: what is beyond it goes, what it grows by is zero."""
    had, has = math.prod(t.shape), math.prod(shape)
    kept = t.df.select(*t.keys, t.flat().alias("id"), "v").filter(F.col("id") < has)
    if has > had:
        new = t.df.sparkSession.range(had, has).select("id", _zero(t).alias("v"))
        kept = kept.unionByName(t.df.select(*t.keys).distinct().crossJoin(new) if t.keys else new)
    return t.cells(indexed(kept, F.col("id"), shape), len(shape), tuple(shape))


def concat(a: Tensor, b: Tensor, axis: int | None = None) -> Tensor:
    """One array after the other, flat or along an axis; an empty one adds nothing."""
    if a.extents is not None and 0 in a.extents:
        return b
    if b.extents is not None and 0 in b.extents:
        return a
    if axis is None:
        a, b, axis = flatten(a), flatten(b), 0
    k = a.axis(axis)
    if a.ndim != b.ndim or not a.keys and any(x != y for j, (x, y) in enumerate(zip(a.shape, b.shape, strict=True)) if j != k):
        raise ValueError(f"ranks {a.ndim} and {b.ndim}, or shapes along axis {k}")
    if not a.keys:
        moved = _index(b, **{f"i{k}": F.col(f"i{k}") + a.shape[k]}).df
        shape = tuple(x + (b.shape[j] if j == k else 0) for j, x in enumerate(a.shape))
    else:
        own = a.df.groupBy(*a.keys).agg((F.max(f"i{k}") + 1).alias("_n"))
        placed = matched(b.df.select(*b.places, "v"), own, list(a.keys), "left")
        index = (F.col(f"i{k}") + F.coalesce("_n", F.lit(0))).alias(f"i{k}")
        moved, shape = placed.select(*a.keys, *(index if j == k else F.col(x) for j, x in enumerate(a.axes)), "v"), None
    return a.cells(a.df.select(*a.places, "v").unionByName(moved), extents=shape)


def stack(*arrays: Tensor, axis: int = 0) -> Tensor:
    """Arrays of one shape along a new axis."""
    first = arrays[0]
    if any(t.shape != first.shape for t in arrays):
        raise ValueError("shapes differ")
    k = axis % (first.ndim + 1)
    out = None
    for number, t in enumerate(arrays):
        index = [F.col(f"i{j}").alias(f"i{j + (j >= k)}") for j in range(t.ndim)]
        part = t.df.select(*t.keys, *index, F.lit(number).cast("long").alias(f"i{k}"), "v")
        out = part if out is None else out.unionByName(part)
    return first.cells(out, first.ndim + 1, (*first.shape[:k], len(arrays), *first.shape[k:]))


def frame(t: Tensor, length: int, hop: int, axis: int = -1) -> Tensor:
    """Overlapping frames of an axis, one more dimension: each cell goes to the frames that hold it."""
    k = t.axis(axis)
    count = max(0, 1 + (t.shape[k] - length) // hop)
    i = F.col(f"i{k}")
    low = F.greatest(F.lit(0), F.ceil((i - length + 1) / F.lit(float(hop)))).cast("long")
    high = F.least(F.lit(count - 1), F.floor(i / hop)).cast("long")
    frames = F.when(low <= high, F.sequence(low, high))
    spread = t.df.withColumn("_f", F.explode(frames))
    index = [F.col(f"i{j}").alias(f"i{j + (j > k)}") for j in range(t.ndim) if j != k]
    new = spread.select(*t.keys, *index, F.col("_f").alias(f"i{k}"), (i - F.col("_f") * hop).alias(f"i{k + 1}"), "v")
    return t.cells(new, t.ndim + 1, (*t.shape[:k], count, length, *t.shape[k + 1 :]))


def insert(t: Tensor, at: int, new, axis: int = 0) -> Tensor:
    """A value, or a block along an axis, before position ``at``."""
    k = t.axis(axis)
    if not 0 <= at <= t.shape[k]:
        raise ValueError(f"position {at}")
    if not isinstance(new, Tensor):
        block = t.df.sparkSession.range(1).select(F.lit(0).cast("long").alias("i0"), literal(complex(new) if t.kind == COMPLEX else new).alias("v"))
        if t.ndim != 1:
            raise ValueError("a single value goes into an array of rank 1")
        new = Tensor(t.df.select(*t.keys).distinct().crossJoin(block) if t.keys else block, 1, t.keys, (1,))
    size = new.shape[k] if new.ndim == t.ndim else 1
    if new.ndim == t.ndim - 1:
        index = [F.col(f"i{j}").alias(f"i{j + (j >= k)}") for j in range(new.ndim)]
        new = new.cells(new.df.select(*new.keys, *index, F.lit(0).cast("long").alias(f"i{k}"), "v"), t.ndim)
    here = F.col(f"i{k}")
    moved = _index(t, **{f"i{k}": F.when(here >= at, here + size).otherwise(here)})
    put = _index(new, **{f"i{k}": here + at})
    return t.cells(moved.df.unionByName(put.df), extents=None if t.keys else tuple(n + (size if j == k else 0) for j, n in enumerate(t.shape)))


def remove(t: Tensor, at: int, n: int = 1, axis: int = 0) -> tuple[Tensor, Tensor]:
    """What is left without ``n`` positions from ``at`` on, and what was there."""
    k = t.axis(axis)
    if not 0 <= at <= at + n <= t.shape[k]:
        raise ValueError(f"positions {at} to {at + n}")
    here = F.col(f"i{k}")
    gone = (here >= at) & (here < at + n)
    left = t.cells(t.df.filter(~gone))
    shape = lambda x: tuple(x if j == k else m for j, m in enumerate(t.shape))
    out = _index(left, **{f"i{k}": F.when(here >= at + n, here - n).otherwise(here)})
    taken = _index(t.cells(t.df.filter(gone)), **{f"i{k}": here - at})
    return out.cells(out.df, extents=shape(t.shape[k] - n)), taken.cells(taken.df, extents=shape(n))


def push(t: Tensor, value) -> Tensor:
    """One more element at the end, of each key's own array."""
    if not t.keys:
        return insert(t, t.shape[0], value)
    last = t.df.groupBy(*t.keys).agg((F.max("i0") + 1).alias("i0")).withColumn("v", literal(complex(value) if t.kind == COMPLEX else value))
    return t.cells(t.df.select(*t.places, "v").unionByName(last))


def pop(t: Tensor) -> tuple[Tensor, Tensor]:
    """The array without its last element, and that element, of each key's own array."""
    if not t.keys:
        return remove(t, t.shape[0] - 1)
    df, (n, *_) = with_sizes(t)
    gone = F.col("i0") == n - 1
    taken = df.filter(gone).withColumn("i0", F.lit(0).cast("long"))
    return t.cells(df.filter(~gone)), t.cells(taken)
