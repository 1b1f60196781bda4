"""Intermediate tables in the folder that all executors share, and small helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that a Python task handles at a time.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and Spark is a single process (tests), a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Sets configuration for the statements inside; two underscores in a name stand for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back.

    This cuts the lineage: what follows survives lost executors without recomputing ``df``. Its
    shuffle files go as soon as the table is there; Python tasks get small batches. The table stays
    until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with settings(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(SLICE_BYTES), spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over slices of some ``SLICE_BYTES``; at a task's end the worker gives free memory back."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(slices(batches))
        release()

    return task


def release() -> None:
    """Gives memory that Arrow and the C library hold but don't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row_digest(*columns: Column) -> Column:
    """128 bits, in hex, by which rows with equal values of ``columns`` are known; nulls differ from empty strings."""
    sized = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.md5(F.concat(*sized).cast("binary"))


def quoted(columns: list[str]) -> list[str]:
    """Names as references, whatever is in them."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def without(docs: DataFrame, own: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose digest ``own`` isn't in ``gone`` (row), with all columns, whatever their names.

    A table of 2**20 slots at most is what every task gets: rows in slots without a digest stay as
    they are, only the others are shuffled.
    """
    slot = F.expr("cast(pmod(xxhash64(row), 1048576) as int)").alias("slot")
    packed = docs.select(own.alias("row"), F.struct(*quoted(docs.columns)).alias("all")).withColumn("slot", slot)
    marks = F.broadcast(gone.select(slot).distinct())
    clear = packed.join(marks, "slot", "left_anti")
    doubtful = packed.join(marks, "slot", "left_semi").join(gone.hint("merge"), "row", "left_anti")
    return clear.select("all.*").unionAll(doubtful.select("all.*"))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from ``taken`` ones in any spelling."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def values(column: pa.Array, rows: int = 512) -> Iterator:
    """A column's values, of which only ``rows`` are Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()
