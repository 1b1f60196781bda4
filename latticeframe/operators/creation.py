"""Arrays from nothing, from Python values and from tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import complexes
from ..tensor import COMPLEX, MAX_RANK, REAL, STRING, Tensor
from .elementwise import literal

#: Cells an array may have.
MAX_CELLS = 2**28
TYPES = {REAL: "double", COMPLEX: complexes.TYPE, STRING: "string"}
DEFAULT_SEED = 42
_seed = [DEFAULT_SEED]


def _checked(shape: Sequence[int]) -> tuple[int, ...]:
    shape = tuple(int(n) for n in shape)
    if not 1 <= len(shape) <= MAX_RANK or min(shape) < 0 or math.prod(shape) > MAX_CELLS:
        raise ValueError(f"shape {shape}")
    return shape


def indexed(df: DataFrame, flat: Column, shape: Sequence[int]) -> DataFrame:
    """Index columns from a row-major place."""
    stride, names = 1, []
    for k in reversed(range(len(shape))):
        names.append((F.pmod(F.floor(flat / stride), F.lit(max(1, shape[k]))) if k else F.floor(flat / stride)).cast("long").alias(f"i{k}"))
        stride *= max(1, shape[k])
    return df.select(*reversed(names), *(c for c in df.columns if c != "id"))


def generated(spark: SparkSession, shape: Sequence[int], value) -> Tensor:
    """``value`` of the index columns (a function of them) in every cell."""
    shape = _checked(shape)
    df = indexed(spark.range(math.prod(shape)), F.col("id"), shape)
    return Tensor(df.withColumn("v", value(*(F.col(f"i{k}") for k in range(len(shape))))), len(shape), (), shape)


def empty(spark: SparkSession, shape: Sequence[int], kind: int = REAL) -> Tensor:
    """No cell, but a rank and an element type; a shape is a reservation only."""
    n = len(_checked(shape))
    schema = ", ".join([*(f"i{k} long" for k in range(n)), f"v {TYPES[kind]}"])
    return Tensor(spark.createDataFrame([], schema), n, (), (0,) * n)


def full(spark: SparkSession, shape: Sequence[int], value) -> Tensor:
    return generated(spark, shape, lambda *_: literal(value))


def zeros(spark: SparkSession, shape: Sequence[int], kind: int = REAL) -> Tensor:
    return full(spark, shape, 0j if kind == COMPLEX else 0.0)


def ones(spark: SparkSession, shape: Sequence[int], kind: int = REAL) -> Tensor:
    return full(spark, shape, 1 + 0j if kind == COMPLEX else 1.0)


def like(t: Tensor, value) -> Tensor:
    """The other array's places and element type, filled with a value."""
    return t.map(lambda _: literal(complex(value) if t.kind == COMPLEX else value))


def identity(spark: SparkSession, n: int, kind: int = REAL) -> Tensor:
    one, none = (1 + 0j, 0j) if kind == COMPLEX else (1.0, 0.0)
    return generated(spark, (n, n), lambda i, j: F.when(i == j, literal(one)).otherwise(literal(none)))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> Tensor:
    if step == 0:
        raise ValueError("step 0")
    return generated(spark, (max(0, math.ceil((stop - start) / step)),), lambda i: F.lit(float(start)) + i * F.lit(float(step)))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> Tensor:
    return generated(spark, (n,), lambda i: F.lit(float(start)) + i * F.lit((stop - start) / max(1, n - 1)))


def logspace(spark: SparkSession, start: float, stop: float, n: int, base: float = 10.0) -> Tensor:
    return linspace(spark, start, stop, n).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(spark: SparkSession, start: float, stop: float, n: int) -> Tensor:
    if start * stop <= 0:
        raise ValueError("the ends of a progression have one sign and aren't 0")
    return generated(spark, (n,), lambda i: F.lit(float(start)) * F.pow(F.lit(stop / start), i / F.lit(float(max(1, n - 1)))))


def seed(value: int) -> None:
    """The seed of what is random from now on; 0 stands for one of the system's choice."""
    _seed[0] = value or int(np.random.SeedSequence().entropy % 2**31)


def rand(spark: SparkSession, shape: Sequence[int], low: float = 0.0, high: float = 1.0) -> Tensor:
    """Uniform numbers, the same for one seed and shape however the cells are partitioned."""
    unit = lambda *i: F.shiftrightunsigned(F.xxhash64(*i, F.lit(_seed[0])), 11) * F.lit(2.0**-53)
    return generated(spark, shape, lambda *i: unit(*i) * F.lit(float(high - low)) + F.lit(float(low)))


def randint(spark: SparkSession, shape: Sequence[int], low: int, high: int) -> Tensor:
    return rand(spark, shape, low, high).map(lambda v: F.floor(v).cast("double"))


def fromarray(spark: SparkSession, values) -> Tensor:
    """From a Python or NumPy array of the driver."""
    a = np.asarray(values)
    kind = STRING if a.dtype.kind in "UO" else COMPLEX if a.dtype.kind == "c" else REAL
    if not a.size:
        return empty(spark, a.shape or (0,), kind)
    cell = {REAL: float, COMPLEX: lambda z: (float(z.real), float(z.imag)), STRING: str}[kind]
    rows = [(*map(int, at), cell(x)) for at, x in np.ndenumerate(a)]
    schema = ", ".join([*(f"i{k} long" for k in range(a.ndim)), f"v {TYPES[kind]}"])
    return Tensor(spark.createDataFrame(rows, schema), a.ndim, (), _checked(a.shape))


def fromcolumn(df: DataFrame, column: str, keys: Sequence[str] = ()) -> Tensor:
    """From an array column, each row an array of its own: its place is the first axis, or ``keys`` name it."""
    if keys:
        return Tensor(df.select(*keys, F.posexplode(column).alias("i0", "v")).select(*keys, F.col("i0").cast("long").alias("i0"), F.col("v").cast("double").alias("v")), 1, tuple(keys))
    raise ValueError("an array column needs keys that name its rows")


def ordered(df: DataFrame, value: Column, order: Sequence[str], keys: Sequence[str] = ()) -> Tensor:
    """Rows as lanes: for each value of ``keys`` its rows in order.

    One lane, or lanes of which one is large, are ranked by ranges of the first column of ``order``, a number or time.
    """
    from .sorting import has_large_key, numbered

    if keys and not has_large_key(df, keys):
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return Tensor(df.select(*keys, at.cast("long").alias("i0"), value.alias("v")), 1, tuple(keys))

    columns = [c for c in order if c not in keys]
    ranked = numbered(df.select(*keys, *columns, value.alias("v")), list(order), keys=keys)
    return Tensor(ranked.select(*keys, F.col("rank").cast("long").alias("i0"), "v"), 1, tuple(keys))


def toarray(t: Tensor) -> np.ndarray:
    """To the driver, as NumPy. Meant for small arrays: more than ``MAX_CELLS`` are refused."""
    if t.keys:
        raise ValueError("one array, not one for each key")
    if math.prod(t.shape) > MAX_CELLS:
        raise ValueError(f"shape {t.shape} is too large for the driver")
    out = np.zeros(t.shape, {REAL: float, COMPLEX: complex, STRING: object}[t.kind])
    for r in t.df.collect():
        out[tuple(r[a] for a in t.axes)] = complex(r.v.re, r.v.im) if t.kind == COMPLEX else r.v
    return out


def packed(t: Tensor) -> DataFrame:
    """(keys..., data): each array's cells in row-major order as one array column; for lanes that fit a row."""
    cells = F.array_sort(F.collect_list(F.struct(t.flat().alias("at"), "v")))
    return t.df.groupBy(*t.keys).agg(F.transform(cells, lambda c: c["v"]).alias("data"))


def fromtable(spark: SparkSession, name: str) -> Tensor:
    """From a table (i0, v) of the catalog."""
    return Tensor(spark.table(name).select(F.col("i0").cast("long").alias("i0"), F.col("v").cast("double").alias("v")), 1)


def totable(t: Tensor, name: str, temporary: bool = True) -> None:
    """To a table of the catalog, or a view."""
    t.need(REAL)
    if temporary:
        t.df.createOrReplaceTempView(name)
    else:
        t.df.write.mode("overwrite").saveAsTable(name)


def text(t: Tensor, edge: int = 3, threshold: int = 1000) -> str:
    """Shape, type and values as NumPy lays them out; of a large array only the edges are fetched."""
    names = {REAL: "real", COMPLEX: "complex", STRING: "string"}
    shape = t.shape
    if math.prod(shape) <= threshold:
        body = np.array2string(toarray(t), precision=5)
    else:
        near = F.lit(True)
        for a, n in zip(t.axes, shape, strict=True):
            near = near & ((F.col(a) < edge) | (F.col(a) >= n - edge))
        body = "\n".join(f"[{', '.join(str(r[a]) for a in t.axes)}] {r.v}" for r in t.df.filter(near).orderBy(*t.axes).collect())
    return f"shape {shape}, {names[t.kind]}\n{body}"


def copy(t: Tensor) -> Tensor:
    """The same cells; DataFrames don't change."""
    return t.cells(t.df, extents=t.extents)


def type_(t: Tensor) -> int:
    return t.kind


def dims(t: Tensor) -> int:
    return t.ndim


def size(t: Tensor) -> int:
    return t.df.count()


def shape(t: Tensor) -> tuple[int, ...]:
    return t.shape


def isempty(t: Tensor) -> float:
    return float(t.df.isEmpty())
