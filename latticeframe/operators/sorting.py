"""Order: global ranks by ranges, sorting, distinct values and sets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType
from pyspark.sql.window import Window

from ..tensor import REAL, Tensor, matched

#: Ranges of values in a global ranking, for each shuffle partition.
RANGES = 2


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double in the same order; all strings are one."""
    kind, x = df.schema[column].dataType, F.col(column)
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), x).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(x).cast("double")
    return F.lit(0.0) if isinstance(kind, StringType) else x.cast("double")


def _limits(df: DataFrame, column: str) -> list[float]:
    """Limits of ranges of about equal size; their number is that of shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES
    marks = [k / n for k in range(1, n)]
    found = df.agg(F.percentile_approx(_number(df, column), marks).alias("q")).first().q or []
    return sorted({x for x in found if x == x})


#: So many limits are looked through one by one.
FEW_LIMITS = 64


def _constants(values: list[float]) -> Column:
    return F.expr(f"cast(split('{','.join(map(repr, values))}', ',') as array<double>)")


def _dealt(df: DataFrame, limits: list[float], x: Column) -> DataFrame:
    """``df`` with ``_p``: how many limits are not above ``x``, first among every n-th, then among the n that follow."""
    below = lambda values: F.size(F.filter(values, lambda q: q <= x))
    step = math.isqrt(len(limits)) + 1
    if len(limits) <= FEW_LIMITS:
        return df.withColumn("_p", below(_constants(limits)) if limits else F.lit(0))
    runs = df.withColumn("_c", below(_constants(limits[step::step])) * step)
    return runs.withColumn("_p", F.col("_c") + below(F.slice(_constants(limits), F.col("_c") + 1, F.lit(step)))).drop("_c")


def numbered(df: DataFrame, order: Sequence[str], descending: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank``: each row's place from 0 by ``order``, whose first column is a number, for each value of ``keys``.

    Rows are dealt by ranges of that column, ranked within them, and the sizes of the ranges
    before are added: no task orders all rows, nor all of a key. Equal first columns stay in one range.
    """
    keys = list(keys)
    limits = _limits(df, order[0])
    dealt = _dealt(df, limits, _number(df, order[0]))
    sizes = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select(*keys, "_p", (F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.desc("_p") if descending else F.asc("_p"))) - F.col("_n")).alias("_before"))
    direction = F.desc if descending else F.asc
    within = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(direction(order[0]), *order[1:])) - 1
    ranked = dealt.withColumn("_r", within)
    joined = matched(ranked, before if keys else F.broadcast(before), [*keys, "_p"])
    return joined.withColumn("rank", F.col("_r") + F.col("_before")).drop("_p", "_r", "_before")


#: Rows of a key that one task may order; where a key has more, its rows are dealt by ranges.
LARGE_KEY = 1 << 20


def has_large_key(df: DataFrame, keys: Sequence[str]) -> bool:
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    return (most or 0) > LARGE_KEY


def selected(df: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., v): the ``q``-quantile of ``v`` (keys..., v), linear between neighbours; NaN if one is, an error without keys if none is there.

    Ranges of values are counted, and only those that hold the wanted ranks are read again, as
    distinct values with their counts.
    """
    keys = list(keys)
    limits = _limits(df, "v")
    dealt = _dealt(df.select(*keys, "v"), limits, F.col("v"))
    sizes = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("n"), F.count_if(F.isnan("v")).alias("nan"))
    each = Window.partitionBy(*keys)
    total = F.sum("n").over(each)
    at = F.lit(float(q)) * (total - 1)
    upto = F.sum("n").over(each.orderBy("_p"))
    marks = sizes.select(*keys, "_p", (upto - F.col("n")).alias("_before"), upto.alias("_upto"), at.alias("_at"), F.sum("nan").over(each).alias("_nan"))
    has = lambda k, low, high: (F.col(low) <= k) & (k < F.col(high))
    low, high = F.floor("_at"), F.ceil("_at")
    marks = marks.filter(has(low, "_before", "_upto") | has(high, "_before", "_upto")).drop("_upto")
    own = matched(dealt, marks if keys else F.broadcast(marks), [*keys, "_p"])
    values = own.groupBy(*keys, "_p", "_before", "_at", "_nan", "v").agg(F.count("*").alias("n"))
    through = F.col("_before") + F.sum("n").over(Window.partitionBy(*keys, "_p").orderBy("v"))
    placed = values.withColumn("_to", through).withColumn("_from", F.col("_to") - F.col("n"))
    pick = lambda k: F.max(F.when(has(k, "_from", "_to"), F.col("v")))
    x, y, part = pick(low), pick(high), F.max(F.col("_at") - low)
    value = F.when(F.max("_nan") > 0, float("nan")).when(part == 0, x).otherwise(x + (y - x) * part)
    if not keys:
        value = F.when(F.count("*") == 0, F.raise_error(F.lit("an empty array has none")).cast("double")).otherwise(value)
    return placed.groupBy(*keys).agg(value.alias("v"))


def ranked_among(source: DataFrame, queries: DataFrame, right: bool) -> DataFrame:
    """``queries`` with ``v`` replaced by the number of source cells before it."""
    both = source.select("v").withColumn("_q", F.lit(False)).unionByName(queries.withColumn("_q", F.lit(True)), allowMissingColumns=True)
    limits = _limits(source, "v")
    dealt = _dealt(both, limits, F.col("v"))
    sizes = dealt.filter("NOT _q").groupBy("_p").agg(F.count("*").alias("_n"))
    parts = matched(dealt.select("_p").distinct(), sizes, ["_p"], "left")
    before = parts.select("_p", (F.sum(F.coalesce("_n", F.lit(0))).over(Window.orderBy("_p")) - F.coalesce("_n", F.lit(0))).alias("_before"))
    first = F.col("_q").cast("int") if right else -F.col("_q").cast("int")
    running = F.count_if(~F.col("_q")).over(Window.partitionBy("_p").orderBy("v", first).rowsBetween(Window.unboundedPreceding, 0))
    placed = matched(dealt.withColumn("_c", running), F.broadcast(before), ["_p"]).filter("_q")
    return placed.withColumn("v", (F.col("_c") + F.col("_before")).cast("double")).drop("_q", "_p", "_c", "_before")


def _lane(t: Tensor, k: int) -> tuple[list[str], str]:
    return [*t.keys, *(a for j, a in enumerate(t.axes) if j != k)], t.axes[k]


def sort(t: Tensor, axis: int | None = -1, descending: bool = False) -> Tensor:
    """Sorted along an axis, by default the last; NaN comes last. A single lane is ranked by ranges."""
    t.need(REAL)
    k = t.axis(axis)
    others, here = _lane(t, k)
    direction = F.desc if descending else F.asc
    if not others:
        return t.cells(numbered(t.df, ["v", here], descending).select(F.col("rank").alias(here), "v"), extents=t.extents)
    place = F.row_number().over(Window.partitionBy(*others).orderBy(direction("v"), here)) - 1
    return t.cells(t.df.withColumn(here, place), extents=t.extents)


def argsort(t: Tensor, axis: int = -1, descending: bool = False) -> Tensor:
    """The indices along an axis that would sort it; equal values stay in order."""
    t.need(REAL)
    k = t.axis(axis)
    others, here = _lane(t, k)
    direction = F.desc if descending else F.asc
    value = F.col(here).cast("double").alias("v")
    if not others:
        return t.cells(numbered(t.df, ["v", here], descending).select(F.col("rank").alias("i0"), value), extents=t.extents)
    place = F.row_number().over(Window.partitionBy(*others).orderBy(direction("v"), here)) - 1
    return t.cells(t.df.withColumn("_p", place).select(*others, F.col("_p").alias(here), value).select(*t.places, "v"), extents=t.extents)


def unique(t: Tensor) -> Tensor:
    """The distinct values in order; all NaN are one."""
    values = t.df.select((F.col("v") + 0.0).alias("v")).distinct()
    return Tensor(numbered(values, ["v"]).select(F.col("rank").alias("i0"), "v"), 1)


def argunique(t: Tensor) -> Tensor:
    """Coordinates of the first cell of each value, by value."""
    first = t.df.groupBy((F.col("v") + 0.0).alias("v")).agg(F.min_by(F.struct(*t.axes), t.flat()).alias("p"))
    places = F.posexplode(F.array(*(F.col(f"p.{a}").cast("double") for a in t.axes)))
    ranked = numbered(first, ["v"]).select(F.col("rank").alias("i0"), places.alias("i1", "v"))
    return Tensor(ranked.select("i0", F.col("i1").cast("long").alias("i1"), "v"), 2)


def shuffle(t: Tensor, seed: int | None = None) -> Tensor:
    """A random order of all cells, the same for one seed however they are partitioned."""
    from .creation import _seed
    from .shape import _reflat

    keyed = t.df.select(*t.keys, t.flat().alias("at"), "v").withColumn("_h", (F.xxhash64("at", F.lit(_seed[0] if seed is None else seed)) / 2.0**63))
    if t.keys:
        place = F.row_number().over(Window.partitionBy(*t.keys).orderBy("_h", "at")) - 1
        return _reflat(t.cells(keyed.withColumn("i0", place), 1), F.col("i0"), t.shape)
    return _reflat(t.cells(numbered(keyed, ["_h", "at"]).select(F.col("rank").alias("i0"), "v"), 1), F.col("i0"), t.shape)


def _heap_order(n: int):
    """Permutations in the order of Heap's algorithm."""
    a, c, i = list(range(n)), [0] * n, 1
    yield tuple(a)
    while i < n:
        if c[i] < i:
            j = c[i] if i % 2 else 0
            a[j], a[i] = a[i], a[j]
            yield tuple(a)
            c[i] += 1
            i = 1
        else:
            c[i] = 0
            i += 1


def perm(t: Tensor, count: int | None = None) -> Tensor:
    """Permutations of a short array of rank 1, one for each row, all or the first ``count``."""
    n = t.shape[0]
    if n > 10:
        raise ValueError("more than 10 elements have too many permutations")
    orders = [p for _, p in zip(range(count) if count is not None else permutations(range(n)), _heap_order(n), strict=False)]
    spark = t.df.sparkSession
    rows = spark.createDataFrame([(k, list(p)) for k, p in enumerate(orders)], "i0 long, p array<long>")
    cells = rows.select("i0", F.posexplode("p").alias("i1", "at"))
    return Tensor(cells.join(t.df.select(F.col("i0").alias("at"), "v"), "at").select("i0", F.col("i1").cast("long").alias("i1"), "v"), 2, (), (len(orders), n))


# sets: ascending arrays of rank 1 without repeats


class SortedSet(Tensor):
    """A set by its distinct values, which are ranked only when its cells are asked for."""

    def __init__(self, values: DataFrame | None = None, **fields) -> None:
        if values is None:
            super().__init__(**fields)
        else:
            self.__dict__.update(values=values, ndim=1, keys=(), extents=None, is_set=True, realtime=False)

    @cached_property
    def df(self) -> DataFrame:
        return numbered(self.values, ["v"]).select(F.col("rank").alias("i0"), "v")


def likeset(t: Tensor) -> Tensor:
    t.need(REAL)
    return SortedSet(t.df.select((F.col("v") + 0.0).alias("v")).distinct())


def unlikeset(t: Tensor) -> Tensor:
    return Tensor(t.df, t.ndim, t.keys, t.extents)


def _values(t: Tensor) -> DataFrame:
    if not t.is_set:
        raise ValueError("the operand isn't a set")
    return t.__dict__["values"] if "values" in t.__dict__ else t.df.select("v")


def _made(df: DataFrame) -> Tensor:
    return SortedSet(df.distinct())


def setinsert(t: Tensor, value: float) -> Tensor:
    return _made(_values(t).unionByName(t.df.sparkSession.range(1).select(F.lit(float(value)).alias("v"))))


def setremove(t: Tensor, value: float) -> Tensor:
    return SortedSet(_values(t).filter(F.col("v") != float(value)))


def setcontains(t: Tensor, value: float) -> float:
    return float(not _values(t).filter(F.col("v") == float(value)).isEmpty())


def setunion(a: Tensor, b: Tensor) -> Tensor:
    return _made(_values(a).unionByName(_values(b)))


def setintersect(a: Tensor, b: Tensor) -> Tensor:
    return SortedSet(_values(a).intersect(_values(b)))


def setdiff(a: Tensor, b: Tensor) -> Tensor:
    return SortedSet(_values(a).subtract(_values(b)))


def setsymdiff(a: Tensor, b: Tensor) -> Tensor:
    x, y = _values(a), _values(b)
    return SortedSet(x.subtract(y).unionByName(y.subtract(x)))


def setissubset(a: Tensor, b: Tensor) -> float:
    return float(_values(a).subtract(_values(b)).isEmpty())


def setissuperset(a: Tensor, b: Tensor) -> float:
    return setissubset(b, a)


def setisdisjoint(a: Tensor, b: Tensor) -> float:
    return float(_values(a).intersect(_values(b)).isEmpty())


def setisequal(a: Tensor, b: Tensor) -> float:
    x, y = _values(a), _values(b)
    return float(x.subtract(y).isEmpty() and y.subtract(x).isEmpty())
