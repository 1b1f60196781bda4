"""Reading, writing and choosing cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tensor import REAL, Tensor
from .elementwise import literal, zipped
from .shape import _index, flatten
from .sorting import numbered


def _at(t: Tensor, *place: int):
    if len(place) != t.ndim:
        raise ValueError(f"{len(place)} indices for rank {t.ndim}")
    if any(not 0 <= i < n for i, n in zip(place, t.shape, strict=True)):
        raise IndexError(f"{place} of {t.shape}")
    here = F.lit(True)
    for a, i in zip(t.axes, place, strict=True):
        here = here & (F.col(a) == i)
    return here


def get(t: Tensor, *place: int) -> Tensor:
    """One cell, as an array of rank 0."""
    return t.cells(t.df.filter(_at(t, *place)), 0, ())


def set(t: Tensor, value, *place: int) -> Tensor:
    """The array with one cell replaced."""
    return t.cells(t.df.withColumn("v", F.when(_at(t, *place), literal(value)).otherwise(F.col("v"))), extents=t.extents)


def take(t: Tensor, index: int, axis: int | None = None) -> Tensor:
    """One position of an axis, which is dropped; without an axis one flat place."""
    if axis is None:
        return t.cells(t.df.filter(t.flat() == index), 0, ())
    k = t.axis(axis)
    rest = [F.col(a).alias(f"i{j - (j > k)}") for j, a in enumerate(t.axes) if j != k]
    return t.cells(t.df.filter(F.col(f"i{k}") == index).select(*t.keys, *rest, "v"), t.ndim - 1)


def getrow(t: Tensor, row: int) -> Tensor:
    return take(t, row, 0)


def getcol(t: Tensor, column: int) -> Tensor:
    return take(t, column, 1)


def _slice(t: Tensor, start: int, stop: int, step: int, axis: int):
    k = t.axis(axis)
    if not 0 <= start < stop <= t.shape[k] or step < 1:
        raise ValueError(f"slice {start}:{stop}:{step} of {t.shape[k]}")
    i = F.col(f"i{k}")
    return k, (i >= start) & (i < stop) & ((i - start) % step == 0), F.floor((i - start) / step).cast("long")


def getslice(t: Tensor, start: int, stop: int, step: int = 1, axis: int = 0) -> Tensor:
    k, inside, place = _slice(t, start, stop, step, axis)
    part = _index(t.cells(t.df.filter(inside)), **{f"i{k}": place})
    return part.cells(part.df, extents=tuple(-(-(stop - start) // step) if j == k else n for j, n in enumerate(t.shape)))


def setslice(t: Tensor, new: Tensor, start: int, stop: int, step: int = 1, axis: int = 0) -> Tensor:
    k, inside, _ = _slice(t, start, stop, step, axis)
    put = _index(new, **{f"i{k}": F.col(f"i{k}") * step + start})
    return t.cells(t.df.filter(~inside).select(*t.places, "v").unionByName(put.df), extents=t.extents)


def select(t: Tensor, mask: Tensor) -> Tensor:
    """The cells that a mask of the same shape marks, flat."""
    kept = zipped(t, mask, lambda v, m: F.struct(v.alias("v"), (m != 0).alias("m")), broadcast=False)
    flat = flatten(kept).df.filter("v.m").select(*t.keys, "i0", F.col("v.v").alias("v"))
    return _renumbered(t, flat)


def _renumbered(t: Tensor, flat: DataFrame) -> Tensor:
    if t.keys:
        place = F.row_number().over(Window.partitionBy(*t.keys).orderBy("i0")) - 1
        return t.cells(flat.withColumn("i0", place), 1)
    return t.cells(numbered(flat, ["i0"]).select(F.col("rank").alias("i0"), "v"), 1)


def compress(t: Tensor, mask: Tensor, axis: int | None = None) -> Tensor:
    """Entries that a mask of rank 1 marks, along an axis or flat; a short mask cuts the rest off."""
    if axis is None:
        t, axis = flatten(t), 0
    k = t.axis(axis)
    kept = numbered(mask.df.filter(F.col("v") != 0).select("i0"), ["i0"]).select(F.col("i0").alias("_i"), "rank")
    joined = t.df.join(kept, F.col(f"i{k}") == F.col("_i"))
    return _index(t.cells(joined.withColumn(f"i{k}", F.col("rank"))))


def coordinates(t: Tensor, df: DataFrame) -> Tensor:
    """The places of cells in row-major order, (matches x rank)."""
    places = F.posexplode(F.array(*(F.col(a).cast("double") for a in t.axes)))
    ranked = numbered(df.select(t.flat().alias("at"), *t.axes), ["at"])
    return Tensor(ranked.select(F.col("rank").alias("i0"), places.alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v"), 2)


def argwhere(t: Tensor, values: Tensor) -> Tensor:
    """Coordinates of the cells equal to one of some values; NaN equals nothing."""
    t.need(REAL)
    wanted = values.df.filter(~F.isnan("v")).select("v").distinct()
    return coordinates(t, t.df.join(wanted, "v", "left_semi"))


def argnonzero(t: Tensor) -> Tensor:
    return coordinates(t, t.df.filter(F.col("v") != 0))


def argisnan(t: Tensor) -> Tensor:
    return coordinates(t, t.df.filter(F.isnan("v")))


def indexof(t: Tensor, value: float) -> Tensor:
    """Coordinates of the first cell equal to a value, or an empty array."""
    found = t.df.filter((F.col("v") == float(value)) & ~F.isnan("v"))
    first = found.groupBy().agg(F.min_by(F.struct(*t.axes), t.flat()).alias("p")).filter("p IS NOT NULL")
    places = F.posexplode(F.array(*(F.col(f"p.{a}").cast("double") for a in t.axes)))
    return Tensor(first.select(places.alias("i0", "v")).select(F.col("i0").cast("long").alias("i0"), "v"), 1)


def bincount(t: Tensor, weights: Tensor | None = None) -> Tensor:
    """How often each whole number from 0 to the largest occurs, or the sum of its weights."""
    t.need(REAL)
    whole = (F.col("v") >= 0) & (F.col("v") == F.floor("v")) & (F.col("v") < 2.0**28)
    number = F.when(whole & ~F.isnan("v"), F.col("v").cast("long")).otherwise(F.raise_error(F.lit("bins are whole numbers from 0 on")).cast("long"))
    if weights is None:
        counts = t.df.select(number.alias("i0")).groupBy("i0").agg(F.count("*").cast("double").alias("v"))
    else:
        both = zipped(t, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")), broadcast=False).df
        counts = both.select("v.v", "v.w").select(number.alias("i0"), "w").groupBy("i0").agg(F.sum("w").alias("v"))
    top = t.df.agg(F.max("v")).first()[0]
    bins = t.df.sparkSession.range(0 if top is None else int(top) + 1).select(F.col("id").alias("i0"))
    return Tensor(bins.join(counts, "i0", "left").select("i0", F.coalesce("v", F.lit(0.0)).alias("v")), 1)


def searchsorted(source: Tensor, queries: Tensor, right: bool = False) -> Tensor:
    """Where each query would go into an ascending array, before or after equal values.

    Queries and source are merged by value: a query's place is the number of source cells that sort
    before it. Within ranges of values these are running counts, and the counts of whole ranges
    are added, so nothing is compared pair by pair.
    """
    from .sorting import ranked_among

    return queries.cells(ranked_among(source.df, queries.df, right), queries.ndim, queries.extents)
