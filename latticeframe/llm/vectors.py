"""Vectors as whole numbers, held as bytes of 64-bit floats: exact for whole numbers below 2**53."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, quoted


def whole_vectors(df: DataFrame, vector: str, scale: int, *others: str) -> DataFrame:
    """``others`` (name or (name, new name)), dims int and x binary of the rows of ``df`` that have a vector of finite numbers.

    x holds floor(scale * component) of each component as little-endian 64-bit floats. Rows whose
    vector is null, or holds null, a non-finite number or one that ``scale`` makes infinite, are left out.
    """
    taken = [F.col(quoted([c])[0]).alias(c) for c in others]
    kinds = ", ".join(f"{quoted([c])[0]} {df.select(quoted([c])[0]).schema[0].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(others))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            with np.errstate(over="ignore"):
                x = np.floor(numbers * scale) + 0.0
            ends = np.cumsum(sizes)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            good = (odd[ends] == odd[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(x.astype("<f8", copy=False))])
            arrays = [*batch.columns[: len(others)], pa.array(sizes.astype(np.int32)), data]
            yield pa.RecordBatch.from_arrays(arrays, [*others, "dims", "x"]).filter(pa.array(good))

    rows = df.select(*taken, F.col(quoted([vector])[0]).cast("array<double>").alias("vector"))
    return rows.mapInArrow(bounded(run), f"{kinds}, dims int, x binary")


def matrix(x: pa.Array, dims: np.ndarray, width: int) -> np.ndarray:
    """The vectors as rows, with zeros up to ``width``."""
    if not len(x):
        return np.zeros((0, width))
    joined = np.frombuffer(b"".join(x.to_pylist()), "<f8")
    if (dims == width).all():
        return joined.reshape(len(x), width)
    out = np.zeros((len(x), width))
    at = np.concatenate([[0], np.cumsum(dims)])
    for k, n in enumerate(dims.tolist()):
        out[k, :n] = joined[at[k] : at[k + 1]]
    return out
