"""Codes of vector parts by codebooks, whose nearest entries are found by a VA-file: cells of coordinates, bounds from tables, refinement."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, quoted, written
from .vectors import matrix, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell's number in each coordinate.
BITS = 5
#: Vectors whose bounds are held at a time.
CHUNK = 512
#: Whole components below this in size have squared distances that fit a long.
LARGEST = 2**26


class CellFile:
    """A codebook's entries approximated by a cell in each coordinate; cells hold equally many entries and end at whole numbers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # (entry, coordinate), int64
        count, width = entries.shape
        cells = min(count, 1 << BITS)
        self.cell = np.empty((width, count), np.int64)
        self.low, self.high = np.empty((width, cells), np.int64), np.empty((width, cells), np.int64)
        starts = np.arange(cells) * count // cells
        for d in range(width):
            order = np.argsort(entries[:, d], kind="stable")
            values = entries[order, d]
            self.low[d] = values[starts]
            self.high[d] = values[np.append(starts[1:], count) - 1]
            self.cell[d, order] = np.searchsorted(starts, np.arange(count), "right") - 1

    def bounds(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (entry, vector) of squared distances, each a sum of a table's values for the entry's cells."""
        low = np.zeros((len(self.entries), len(vectors)), np.int64)
        high = np.zeros_like(low)
        for d in range(vectors.shape[1]):
            y = vectors[:, d]
            below, above = self.low[d][:, None] - y, y - self.high[d][:, None]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            low += np.take(near * near, self.cell[d], axis=0)
            high += np.take(far * far, self.cell[d], axis=0)
        return low, high

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each vector (ties: the lower index) and its squared distance."""
        if not vectors.shape[1]:
            return np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        low, high = self.bounds(vectors)
        # only entries whose lower bound doesn't exceed the least upper bound can be nearest
        row, entry = np.nonzero((low <= high.min(axis=0)).T)
        gap = vectors[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, starts)
        best = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(starts, len(row)))))
        first = best[np.concatenate([[True], row[best[1:]] != row[best[:-1]]])]
        return entry[first], least


def assign(vectors: np.ndarray, files: list[CellFile]) -> tuple[np.ndarray, np.ndarray]:
    """Entry (vector, part) nearest to each part, and its squared distance."""
    width = vectors.shape[1] // PARTS
    codes, errors = np.empty((len(vectors), PARTS), np.int64), np.empty((len(vectors), PARTS), np.int64)
    for at in range(0, len(vectors), CHUNK):
        some = slice(at, at + CHUNK)
        for p, file in enumerate(files):
            codes[some, p], errors[some, p] = file.nearest(vectors[some, p * width : (p + 1) * width])
    return codes, errors


def _whole(x: pa.Array, dims: np.ndarray, width: int) -> np.ndarray:
    out = matrix(x, dims, width)
    if out.size and np.abs(out).max() >= LARGEST:
        raise ValueError(f"a component of {LARGEST} or more: squared distances don't fit a long")
    return out.astype(np.int64)


def entry_sums(vectors: DataFrame, files: list[CellFile], width: int) -> np.ndarray:
    """Sums (part, entry, coordinate), and counts at the last place, of the parts nearest to each entry.

    Each task adds up its own rows; what tasks found is added up by slot, whose number depends on
    the codebooks alone.
    """
    part = width // PARTS
    slots = PARTS * len(files[0].entries) * (part + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, len(files[0].entries), part + 1), np.int64)
        for batch in batches:
            x = _whole(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False), width)
            codes, _ = assign(x, files)
            for p in range(PARTS if len(x) else 0):
                order = np.argsort(codes[:, p], kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(codes[order, p]) > 0]))
                own = np.concatenate([x[order, p * part : (p + 1) * part], np.ones((len(x), 1), np.int64)], axis=1)
                sums[p, codes[order[starts], p]] += np.add.reduceat(own, starts, axis=0)
        flat = sums.reshape(-1)
        used = np.flatnonzero(np.repeat(sums[:, :, -1].reshape(-1) > 0, part + 1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], ["slot", "total"])

    found = vectors.select("dims", "x").mapInArrow(bounded(run), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(slots, np.int64)
    out[found["slot"].to_numpy()] = found["total"].to_numpy()
    return out.reshape(PARTS, len(files[0].entries), part + 1)


def fit_codebooks(vectors: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, coordinate) after ``ROUNDS`` rounds over all vectors; they begin with the vectors of the smallest ids.

    ``vectors`` has id, dims and x. At most ``ENTRIES`` vectors and the sums of their slots come to the driver.
    """
    first = vectors.orderBy(F.asc_nulls_last("id"), "x").limit(ENTRIES).select("dims", "x").toArrow()
    x = _whole(first["x"].combine_chunks(), first["dims"].to_numpy(), width)
    books = np.stack(np.split(x, PARTS, axis=1))
    for _ in range(ROUNDS):
        sums = entry_sums(vectors, [CellFile(b) for b in books], width)
        counts = sums[:, :, -1:]
        books = np.where(counts > 0, sums[:, :, :-1] // np.maximum(counts, 1), books)
    return books


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Codes all vectors: vec_id, code, error, label_error, codebooks_sha256.

    Takes the three named columns and ignores others. Components are floor(1024 * component). Rows
    whose vector is null or holds null or non-finite components are left out; rows with null ids or
    labels, and repeated rows, are vectors like others (ids beside the smallest 256 don't matter,
    null ones come last, rows of equal ids in order of their bytes). Vectors shorter than the
    longest, and a longest one that 4 doesn't divide, end with zeros. Fewer than 256 rows make
    shorter codebooks; an empty table gives an empty result. Whole components of ``LARGEST`` or more
    in size raise an error.

    Each round is one pass that shuffles sums of its tasks; codes are written to the shared folder
    and joined with the errors of their labels, of which Spark sends few to every task and splits
    frequent ones among many.
    """
    renamed = vectors.select(*(F.col(quoted([c])[0]).alias(n) for c, n in ((vec_id, "id"), (label, "label"), (vector, "vector"))))
    rows = whole_vectors(renamed, "vector", SCALE, "id", "label")
    widest = rows.agg(F.max("dims")).first()[0]
    kind = renamed.schema["label"].dataType.simpleString()
    schema = f"vec_id {renamed.schema['id'].dataType.simpleString()}, label {kind}, code string, error long"
    if widest is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {renamed.schema['id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-widest // PARTS) * PARTS
    books = fit_codebooks(rows, width)
    files = [CellFile(b) for b in books]
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(_whole(batch.column(3), batch.column(2).to_numpy(zero_copy_only=False), width), files)
            named = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(named, pa.string()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    coded = written(rows.mapInArrow(bounded(run), schema), "codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
