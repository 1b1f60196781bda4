"""Matrices as tiles: a row for each block of cells, products by pairs of tiles, and elimination by panels.

A tile is a bounded group of cells, so neither a matrix nor one of its rows or columns is in one task.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..functions import complexes
from ..tensor import Tensor

#: Rows and columns of a tile.
TILE = 256
#: Bytes of sums that a task of a product holds before it hands them on.
HELD_BYTES = 64 << 20
#: Panels whose candidates for pivots are compared together.
COMPARED = 16


@contextmanager
def of_side(side: int) -> Iterator[None]:
    """Tiles of another side for the statements inside."""
    global TILE
    before, TILE = TILE, side
    try:
        yield
    finally:
        TILE = before


def _floats(table: pa.Table, dtype: type) -> np.ndarray:
    x = table["re"].to_numpy()
    return x + 1j * table["im"].to_numpy() if dtype is complex else x


def tiled(df: DataFrame, groups: list[str], row: str, column: str, rows: int, columns: int, is_complex: bool, side: int | None = None) -> DataFrame:
    """(groups..., bi, bj, x binary, has binary) of cells (groups..., row, column, v): tiles of numbers, row by row, and which of their cells exist.

    A tile ends where the matrix (``rows`` x ``columns``) does.
    """
    side = side or TILE
    dtype = complex if is_complex else float
    value = (F.col("v.re").alias("re"), F.col("v.im").alias("im")) if dict(df.dtypes)["v"].startswith("struct") else (F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    place = lambda c: (F.floor(F.col(c) / side).alias("b" + ("i" if c == row else "j")), F.pmod(c, F.lit(side)).alias("l" + ("i" if c == row else "j")))
    cells = df.select(*groups, *place(row), *place(column), *value)

    def made(key: tuple, table: pa.Table) -> pa.Table:
        bi, bj = (k.as_py() for k in key[-2:])
        x = np.zeros((min(side, rows - bi * side), min(side, columns - bj * side)), dtype)
        has = np.zeros(x.shape, bool)
        at = table["li"].to_numpy(), table["lj"].to_numpy()
        x[at] = _floats(table, dtype)
        has[at] = True
        own = [pa.array([k.as_py()], k.type) for k in key]
        return pa.Table.from_arrays([*own, pa.array([x.tobytes()], pa.binary()), pa.array([np.packbits(has).tobytes()], pa.binary())], [*groups, "bi", "bj", "x", "has"])

    fields = [cells.schema[c] for c in (*groups, "bi", "bj")]
    return cells.groupBy(*groups, "bi", "bj").applyInArrow(made, StructType([*fields, StructField("x", BinaryType()), StructField("has", BinaryType())]))


def products(left: DataFrame, right: DataFrame, shared: list[str], first: list[str], second: list[str], sizes: tuple[int, int, int], is_complex: bool) -> DataFrame:
    """(shared..., first..., second..., r, c, v): sums over k of left cells (shared..., first..., r, k, v) times right ones (shared..., second..., k, c, v).

    Pairs of tiles of one block of k meet in a join; a task adds up the products of each tile of the
    result before cells are shuffled for the remaining sum. A result cell needs a left cell in its row
    and a right one in its column; other cells that don't exist count as 0.
    """
    rows, inner, columns = sizes
    side, dtype = TILE, complex if is_complex else float
    a = tiled(left, [*shared, *first], "r", "k", rows, inner, is_complex).withColumnsRenamed({"bj": "bk", "x": "xa", "has": "ha"})
    b = tiled(right, [*shared, *second], "k", "c", inner, columns, is_complex).withColumnsRenamed({"bi": "bk", "x": "xb", "has": "hb"})
    other = b.select(*(F.col(c).alias(f"_of_{c}") for c in (*shared, "bk")), *second, "bj", "xb", "hb")
    pairs = a.join(other, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*shared, "bk")])
    groups = [*shared, *first, *second]
    pairs = pairs.select(*groups, "bi", "bk", "bj", "xa", "ha", "xb", "hb")
    fields = [pairs.schema[c] for c in groups]
    schema = StructType([*fields, StructField("r", LongType()), StructField("c", LongType()), StructField("re", DoubleType()), *([StructField("im", DoubleType())] if is_complex else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        held = 0

        def cells(key: tuple, x: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
            r, c = np.nonzero(has)
            own = [pa.array([k] * len(r), kind) for k, kind in zip(key, kinds, strict=False)]
            v = x[r, c]
            parts = [v.real, v.imag] if is_complex else [v]
            return pa.RecordBatch.from_arrays([*own, pa.array(r + key[-2] * side), pa.array(c + key[-1] * side), *(pa.array(np.ascontiguousarray(p)) for p in parts)], [f.name for f in schema.fields])

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in groups]
            for row in range(batch.num_rows):
                *key, bi, bk, bj, xa, ha, xb, hb = (c[row].as_py() for c in batch.columns)
                shape = min(side, rows - bi * side), min(side, inner - bk * side), min(side, columns - bj * side)
                x = np.frombuffer(xa, dtype).reshape(shape[:2]) @ np.frombuffer(xb, dtype).reshape(shape[1:])
                bits = lambda h, n, m: np.unpackbits(np.frombuffer(h, np.uint8), count=n * m).reshape(n, m)
                has = np.outer(bits(ha, *shape[:2]).any(axis=1), bits(hb, *shape[1:]).any(axis=0))
                at = (*key, bi, bj)
                if at in sums:
                    sums[at][0] += x
                    sums[at][1] |= has
                else:
                    sums[at] = [x, has]
                    held += x.nbytes + has.nbytes
                while held > HELD_BYTES:
                    oldest = next(iter(sums))
                    x, has = sums.pop(oldest)
                    held -= x.nbytes + has.nbytes
                    yield cells(oldest, x, has)
        for at, (x, has) in sums.items():
            yield cells(at, x, has)

    found = pairs.mapInArrow(run, schema).groupBy(*groups, "r", "c")
    total = complexes.make(F.sum("re"), F.sum("im")) if is_complex else F.sum("re")
    return found.agg(total.alias("v"))


# elimination


def scratch(spark: SparkSession) -> str:
    """A new path that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/tiles-{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """In the shared folder, in a part for each value of ``by``, so that the next step doesn't depend on what executors hold."""
    path, schema = scratch(df.sparkSession), df.schema
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def pivoted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order in which partial pivoting takes them for the columns, and the pivots."""
    x, order, pivots = x.copy(), np.arange(len(x)), []
    for k in range(min(x.shape)):
        p = k + int(np.abs(x[k:, k]).argmax())
        x[[k, p]], order[[k, p]] = x[[p, k]], order[[p, k]]
        pivots.append(x[k, k])
        if x[k, k] != 0:
            x[k + 1 :, k:] -= np.outer(x[k + 1 :, k] / x[k, k], x[k, k:])
    return order[: len(pivots)], np.array(pivots)


CANDIDATES = "g long, ids binary, x binary"


def _candidates(panel: DataFrame, width: int, free: np.ndarray, side: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that win the tournament for a panel's pivots, and their cells of the panel.

    Of each tile's free rows partial pivoting takes as many as there are columns; winners of
    ``COMPARED`` tiles meet in the next round, until one set is left.
    """

    def best(g: int, ids: np.ndarray, x: np.ndarray) -> tuple[int, bytes, bytes]:
        order, _ = pivoted(x)
        return g, ids[order].tobytes(), np.ascontiguousarray(x[order]).tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, data in zip(batch["g"].to_pylist(), batch["x"].to_pylist(), strict=True):
                x = np.frombuffer(data).reshape(-1, width)
                ids = np.arange(g * side, g * side + len(x))
                open_ = free[ids]
                rows.append(best(g // COMPARED, ids[open_], x[open_]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[], [], []], (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["g", "ids", "x"])

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        x = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(-1, width)
        by_id = np.argsort(ids, kind="stable")  # whatever the order in which they came
        g, own, cells = best(key[0].as_py() // COMPARED, ids[by_id], x[by_id])
        return pa.table({"g": [g], "ids": pa.array([own], pa.binary()), "x": pa.array([cells], pa.binary())})

    found = panel.select("g", "x").mapInArrow(first, CANDIDATES)
    n = -(-blocks // COMPARED)
    while True:
        found = found.groupBy("g").applyInArrow(merged, CANDIDATES)
        if n == 1:
            break
        n = -(-n // COMPARED)
    row = found.first()
    return np.frombuffer(bytes(row.ids), np.int64), np.frombuffer(bytes(row.x)).reshape(-1, width)


@dataclass(frozen=True)
class Grid:
    """Tiles of an n x n matrix, and of other columns that follow it."""

    n: int
    columns: int
    side: int

    @property
    def blocks(self) -> int:
        return -(-self.n // self.side)

    @property
    def beside(self) -> int:
        return -(-self.columns // self.side)

    def width(self, j: int) -> int:
        return min(self.side, self.n - j * self.side if j < self.blocks else self.columns - (j - self.blocks) * self.side)

    def height(self, g: int) -> int:
        return min(self.side, self.n - g * self.side)


class Elimination:
    """Gauss-Jordan elimination of a square matrix by panels of columns, with other columns beside it.

    At each panel a tournament finds as many pivot rows as the panel has columns, among rows that
    haven't been pivots. Rows stay where they are. With the pivots' cells P of the panel and R = P^-1
    times the pivot rows, each tile becomes its own less C R, where C are the panel's cells of its
    rows, for pivot rows less the identity, which makes them R. The panel isn't needed any more. In the end
    the other columns are the solution, with rows in the order of the pivots. The driver holds a
    panel's P and the rows' numbers (8 bytes each).
    """

    def __init__(self, a: Tensor, right: DataFrame | None = None, columns: int = 0):
        self.grid = grid = Grid(a.shape[0], columns, TILE)
        spark = a.df.sparkSession
        own = tiled(a.df, [], "i0", "i1", grid.n, grid.n, False).select(F.col("bi").alias("g"), F.col("bj").alias("j"), "x")
        if right is not None:
            more = tiled(right, [], "i0", "i1", grid.n, columns, False)
            own = own.unionByName(more.select(F.col("bi").alias("g"), (F.col("bj") + grid.blocks).alias("j"), "x"))
        across = grid.blocks + grid.beside
        every = spark.range(grid.blocks * across).select(F.floor(F.col("id") / across).alias("g"), F.pmod("id", F.lit(across)).alias("j"))
        self.tiles = written(self._filled(every.join(own, ["g", "j"], "left")))
        self.order: list[np.ndarray] = []
        self.pivots: list[np.ndarray] = []
        largest = a.df.agg(F.max(F.abs("v"))).first()[0] or 0.0
        self.least = grid.n * np.finfo(float).eps * largest

    def _filled(self, df: DataFrame) -> DataFrame:
        """Tiles without a cell are zeros."""
        grid = self.grid

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                g, j, x = (batch[c].to_pylist() for c in "gjx")
                whole = [bytes(8 * grid.height(a) * grid.width(b)) if c is None else c for a, b, c in zip(g, j, x, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["g"], batch["j"], pa.array(whole, pa.binary())], ["g", "j", "x"])

        return df.select("g", "j", "x").mapInArrow(run, "g long, j long, x binary")

    def run(self) -> bool:
        """Whether the matrix is regular; the elimination ends at the first pivot below the rounding of the largest cell."""
        grid, free = self.grid, np.ones(self.grid.n, bool)
        for k in range(grid.blocks):
            ids, cells = _candidates(self.tiles.filter(F.col("j") == k), grid.width(k), free.copy(), grid.side, grid.blocks)
            order, pivots = pivoted(cells)
            if len(pivots) < grid.width(k) or np.abs(pivots).min() <= self.least:
                return False
            ids, cells = ids[order], cells[order]
            free[ids] = False
            self.order.append(ids)
            self.pivots.append(pivots)
            if k + 1 < grid.blocks + grid.beside:
                self.tiles = written(self._step(k, ids, np.linalg.inv(cells)))
        return True

    def _step(self, k: int, ids: np.ndarray, inverse: np.ndarray) -> DataFrame:
        side, width, height, inner = self.grid.side, self.grid.width, self.grid.height, self.grid.width(k)
        rest = self.tiles.filter(F.col("j") > k)
        place = {int(r): i for i, r in enumerate(ids)}

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Pivot rows' parts of each tile that has any."""
            for batch in batches:
                out = []
                for g, j, data in zip(*(batch[c].to_pylist() for c in "gjx"), strict=True):
                    mine = [(i, r - g * side) for r, i in place.items() if r // side == g]
                    if mine:
                        x = np.frombuffer(data).reshape(height(g), width(j))
                        out.append((j, np.array([i for i, _ in mine]).tobytes(), x[[r for _, r in mine]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["j", "at", "x"])

        def rows(key: tuple, table: pa.Table) -> pa.Table:
            j = key[0].as_py()
            x = np.zeros((inner, width(j)))
            x[np.frombuffer(b"".join(table["at"].to_pylist()), np.int64)] = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(-1, width(j))
            return pa.table({"j": [j], "r": pa.array([(inverse @ x).tobytes()], pa.binary())})

        def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for g, data in zip(batch["g"].to_pylist(), batch["x"].to_pylist(), strict=True):
                    c = np.frombuffer(data).reshape(height(g), inner).copy()
                    for r, i in place.items():
                        if r // side == g:
                            c[r - g * side, i] -= 1
                    out.append(c.tobytes())
                yield pa.RecordBatch.from_arrays([batch["g"], pa.array(out, pa.binary())], ["g", "c"])

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for g, j, x, c, r in zip(*(batch[name].to_pylist() for name in ("g", "j", "x", "c", "r")), strict=True):
                    less = np.frombuffer(c).reshape(height(g), inner) @ np.frombuffer(r).reshape(inner, width(j))
                    out.append((np.frombuffer(x).reshape(less.shape) - less).tobytes())
                yield pa.RecordBatch.from_arrays([batch["g"], batch["j"], pa.array(out, pa.binary())], ["g", "j", "x"])

        pivot_rows = rest.mapInArrow(pieces, "j long, at binary, x binary").groupBy("j").applyInArrow(rows, "j long, r binary")
        panel = self.tiles.filter(F.col("j") == k).mapInArrow(factors, "g long, c binary")
        return rest.join(panel, "g").join(pivot_rows, "j").mapInArrow(update, "g long, j long, x binary")

    def determinant(self) -> float:
        """Of a regular matrix: the pivots' product, with the sign of the order of rows."""
        order = np.concatenate(self.order)
        sign, seen = 1.0, np.zeros(self.grid.n, bool)
        for start in range(self.grid.n):
            length, at = 0, start
            while not seen[at]:
                seen[at], at, length = True, order[at], length + 1
            sign = -sign if length and length % 2 == 0 else sign
        mantissa, exponent = sign, 0
        for p in np.concatenate(self.pivots).tolist():
            mantissa, more = math.frexp(mantissa * p)
            exponent += more
        try:
            return math.ldexp(mantissa, exponent)
        except OverflowError:
            return math.copysign(math.inf, mantissa)

    def solution(self) -> DataFrame:
        """Cells (i0, i1, v) of the other columns, by unknown."""
        unknown = np.empty(self.grid.n, np.int64)
        unknown[np.concatenate(self.order)] = np.arange(self.grid.n)
        side, blocks, height, width = self.grid.side, self.grid.blocks, self.grid.height, self.grid.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, j, data in zip(*(batch[c].to_pylist() for c in "gjx"), strict=True):
                    h, w = height(g), width(j)
                    at = np.repeat(unknown[g * side : g * side + h], w), np.tile(np.arange(w) + (j - blocks) * side, h)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(np.frombuffer(data))], ["i0", "i1", "v"])

        return self.tiles.mapInArrow(run, "i0 long, i1 long, v double")
