"""Arrays of any rank as DataFrames: one row for each cell."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

MAX_RANK = 8
REAL, COMPLEX, STRING = 0, 1, 2


@dataclass(frozen=True)
class Tensor:
    """Cells (keys..., i0, i1, ..., v) of one array, or of one array for each value of ``keys``.

    ``v`` is a double, a struct of re and im, or a string. ``extents`` may be left out; the shape
    is then read from the cells. An array without cells may still have a shape.
    """

    df: DataFrame
    ndim: int
    keys: tuple[str, ...] = ()
    extents: tuple[int, ...] | None = None
    is_set: bool = field(default=False)
    realtime: bool = field(default=False)

    def __post_init__(self) -> None:
        if not 0 <= self.ndim <= MAX_RANK:
            raise ValueError(f"rank {self.ndim} is not within 0 to {MAX_RANK}")

    @staticmethod
    def of(spark: SparkSession, values) -> Tensor:
        """An array of given values: ``[1, 2, 3]`` and nested lists."""
        from .operators.creation import fromarray

        return fromarray(spark, values)

    @property
    def axes(self) -> tuple[str, ...]:
        return tuple(f"i{k}" for k in range(self.ndim))

    @property
    def places(self) -> tuple[str, ...]:
        return (*self.keys, *self.axes)

    @cached_property
    def kind(self) -> int:
        """0 for real, 1 for complex, 2 for string."""
        t = self.df.schema["v"].dataType
        if isinstance(t, StructType):
            return COMPLEX
        if isinstance(t, StringType):
            return STRING
        if isinstance(t, NumericType):
            return REAL
        raise TypeError(f"cells of type {t}")

    @cached_property
    def shape(self) -> tuple[int, ...]:
        """Extents; with keys, the largest of all arrays."""
        if self.extents is not None:
            return self.extents
        if not self.ndim:
            return ()
        row = self.df.agg(*(F.max(a).alias(a) for a in self.axes)).first()
        return tuple(0 if x is None else x + 1 for x in row)

    def axis(self, axis: int) -> int:
        """A valid axis, negative ones counted from the end."""
        if isinstance(axis, bool) or axis != int(axis) or not -self.ndim <= axis < self.ndim:
            raise ValueError(f"axis {axis} of an array of rank {self.ndim}")
        return int(axis) % self.ndim

    def strides(self) -> list[int]:
        out = [1]
        for n in reversed(self.shape[1:]):
            out.insert(0, out[0] * n)
        return out if self.ndim else []

    def flat(self) -> Column:
        """A cell's place in row-major order."""
        return sum((F.col(a) * s for a, s in zip(self.axes, self.strides(), strict=True)), F.lit(0).cast("long")).cast("long")

    def cells(self, df: DataFrame, ndim: int | None = None, extents: tuple[int, ...] | None = None) -> Tensor:
        """An array of other cells with the same keys."""
        n = self.ndim if ndim is None else ndim
        return Tensor(df.select(*self.keys, *(F.col(f"i{k}").cast("long").alias(f"i{k}") for k in range(n)), "v"), n, self.keys, extents)

    def map(self, f) -> Tensor:
        """``f`` of each element."""
        return replace(self, df=self.df.select(*self.places, f(F.col("v")).alias("v")), is_set=False)

    def need(self, *kinds: int) -> None:
        if self.kind not in kinds:
            raise TypeError(f"element type {self.kind} is not allowed here")

    # syntax
    def __add__(self, x):
        return _operator("add", self, x)

    def __radd__(self, x):
        return _operator("add", self, x, swapped=True)

    def __sub__(self, x):
        return _operator("subtract", self, x)

    def __rsub__(self, x):
        return _operator("subtract", self, x, swapped=True)

    def __mul__(self, x):
        return _operator("mul", self, x)

    def __rmul__(self, x):
        return _operator("mul", self, x, swapped=True)

    def __truediv__(self, x):
        return _operator("div", self, x)

    def __rtruediv__(self, x):
        return _operator("div", self, x, swapped=True)

    def __pow__(self, x):
        return _operator("pow", self, x)

    def __rpow__(self, x):
        return _operator("pow", self, x, swapped=True)

    def __getitem__(self, at):
        """``t[1, 2]`` is one cell; ``t[a:b:step]`` or ``t[a:b:step, axis]`` is a slice that includes ``b``."""
        from .operators import indexing

        if isinstance(at, slice):
            at = (at, 0)
        if isinstance(at, tuple) and at and isinstance(at[0], slice):
            part, axis = at
            stop = self.shape[self.axis(axis)] if part.stop is None else part.stop + 1
            return indexing.getslice(self, part.start or 0, stop, part.step or 1, axis)
        return indexing.get(self, *(at if isinstance(at, tuple) else (at,)))

    def put(self, at: tuple[int, ...], value) -> Tensor:
        """The array with one cell replaced: assignment to ``t[i, j]``."""
        from .operators import indexing

        return indexing.set(self, value, *at)


def _operator(name: str, a: Tensor, b, swapped: bool = False) -> Tensor:
    from .operators import elementwise, strings

    if a.kind == STRING:
        return strings.concat(b, a) if swapped and name == "add" else strings.concat(a, b) if name == "add" else strings.repeat(a, b)
    return elementwise.binary(name, b, a) if swapped else elementwise.binary(name, a, b)


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal ``keys``, nulls among them, with each key once; other columns have different names.

    Both sides often come from one table. Of a null-safe equality Spark infers no filter from one
    side's computed keys for the other, where their sources are other columns.
    """
    renamed = right.select(*(F.col(c).alias(f"_of_{c}") for c in keys), *(c for c in right.columns if c not in keys))
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], how).drop(*(f"_of_{c}" for c in keys))
