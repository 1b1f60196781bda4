"""Data sources that read and write one array file by many tasks, each its own range of bytes.

Headers are read once, when the plan is made; cells go between files and tasks only. Files are
read on any file system that Arrow opens. A file is written in place, which takes a file system with
writes at any position that all executors share (a local one, where Spark is a single process).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import complexes
from ..tensor import COMPLEX, REAL, STRING
from .flac import read_frames
from .layouts import CSN_LENGTH, LAYOUTS, Layout

#: Payload bytes of one task when a file is read, and cells of a batch.
SPLIT_BYTES, BATCH_CELLS = 16 << 20, 1 << 16

VALUES = {REAL: "v double", COMPLEX: f"v {complexes.TYPE}", STRING: "v string"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its name there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, kinds: tuple[str, ...]) -> list[fs.FileInfo]:
    """The file of a path, or a folder's files of those kinds in order of their names."""
    where, name = opened(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = where.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((x for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith(kinds)), key=lambda x: x.path)


def layout_of(where: fs.FileSystem, info: fs.FileInfo) -> Layout:
    kind = os.path.splitext(info.path)[1].lower()
    if kind not in LAYOUTS:
        raise ValueError(f"{info.path}: files end with {', '.join(LAYOUTS)}")
    with where.open_input_file(info.path) as f:
        try:
            return LAYOUTS[kind](f, info.size)
        except ValueError as e:
            raise ValueError(f"{info.path}: {e}") from e


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__(None)


def value_array(kind: int, x) -> pa.Array:
    if kind == COMPLEX:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x.real)), pa.array(np.ascontiguousarray(x.imag))], ["re", "im"])
    return pa.array(x.tolist() if kind == STRING and isinstance(x, np.ndarray) else x, pa.string() if kind == STRING else pa.float64())


class ArrayFiles(DataSource):
    """``spark.read.format("array_files").load(path)``: rows (path, i0, i1, ..., v) of a file or a folder's files, all of one rank and element type.

    A range of bytes is a task; of FLAC, the frames that begin there. Strings that follow their lengths
    have no places to begin at, so such a file is one task.
    """

    @classmethod
    def name(cls) -> str:
        return "array_files"

    def _files(self) -> list[tuple[str, Layout]]:
        where, _ = opened(self.options["path"])
        return [(x.path, layout_of(where, x)) for x in listed(self.options["path"], tuple(LAYOUTS))]

    def schema(self) -> str:
        files = self._files()
        if not files:
            raise ValueError(f"no array files in {self.options['path']}")
        forms = {(len(x.shape), x.kind) for _, x in files}
        if len(forms) > 1:
            raise ValueError(f"files of several ranks or element types: {sorted(forms)}")
        rank, kind = forms.pop()
        return ", ".join(["path string", *(f"i{k} long" for k in range(rank)), VALUES[kind]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(self.options["path"], self._files())


class RangeReader(DataSourceReader):
    def __init__(self, path: str, files: list[tuple[str, Layout]]):
        self.path, self.files = path, files

    def partitions(self) -> list[Range]:
        out = []
        for name, x in self.files:
            if x.frames:
                end = x.at + x.bytes
                out += [Range(name, x, start, min(start + SPLIT_BYTES, end)) for start in range(x.at, end, SPLIT_BYTES)]
                continue
            step = max(1, SPLIT_BYTES // x.width) if x.width else max(1, x.size)
            out += [Range(name, x, start, min(start + step, x.size)) for start in range(0, x.size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.path)
        x = part.layout
        if x.frames:
            with where.open_input_file(part.path) as f:
                for first, samples in read_frames(f, x.at + x.bytes, x.frames, part.start, part.stop):
                    yield self._sound(part.path, first, samples / x.scale)
            return
        with where.open_input_file(part.path) as f:
            f.seek(x.at + part.start * x.width)
            for start in range(part.start, part.stop, BATCH_CELLS):
                stop = min(start + BATCH_CELLS, part.stop)
                if x.cell:
                    raw = f.read((stop - start) * x.width)
                    if len(raw) < (stop - start) * x.width:
                        raise ValueError(f"{part.path} ends early")
                    v = x.values(raw)
                else:
                    v = [self._string(f, part.path) for _ in range(stop - start)]
                at = [pa.array(i.astype(np.int64)) for i in x.places(start, stop)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * (stop - start)), *at, value_array(x.kind, v)], ["path", *(f"i{k}" for k in range(len(at))), "v"])
            if not x.cell and f.tell() != x.at + x.bytes:
                raise ValueError(f"{part.path}: strings end at byte {f.tell()} instead of {x.at + x.bytes}")

    @staticmethod
    def _sound(path: str, first: int, x: np.ndarray) -> pa.RecordBatch:
        channels, n = x.shape
        columns = [path] * x.size, np.repeat(np.arange(channels), n), np.tile(np.arange(first, first + n), channels), x.ravel()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["path", "i0", "i1", "v"])

    @staticmethod
    def _string(f, name: str) -> str:
        head = f.read(CSN_LENGTH.size)
        body = f.read(CSN_LENGTH.unpack(head)[0]) if len(head) == CSN_LENGTH.size else b""
        if len(head) < CSN_LENGTH.size or len(body) < CSN_LENGTH.unpack(head)[0]:
            raise ValueError(f"{name} ends early")
        return body.decode()


def local(path: str) -> str:
    """The name of a path that can be written at any place."""
    where, name = opened(path)
    if not isinstance(where, fs.LocalFileSystem):
        raise ValueError(f"{path}: one file is written in place, on a shared file system that allows it; Parquet has no such limit")
    return name


@dataclass
class Written(WriterCommitMessage):
    cells: int


class ByteRanges(DataSource):
    """``df.write.format("byte_ranges")``: rows (at, v) to one file of ``size`` bytes that begins with ``header`` (hex).

    v is bytes, or a value that becomes a cell of NumPy's type ``cell``. Bytes that no row writes are 0.
    Tasks write to a file of another name, a repeated task the same bytes again. Only when all have
    ended, the header is written and the file gets its name; else it is removed.
    """

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RangeWriter(self.options)


class RangeWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.cell = local(options["path"]), options.get("cell", "")
        self.header, self.size = bytes.fromhex(options["header"]), int(options["size"])
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.draft, "wb") as f:
            f.truncate(self.size)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        cells = 0
        with open(self.draft, "r+b") as f:
            for batch in batches:
                at, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                cells += len(at)
                if not self.cell:
                    for place, body in zip(at.tolist(), v.to_pylist(), strict=True):
                        f.seek(place)
                        f.write(body)
                    continue
                x = self._cells(v)
                starts = np.flatnonzero(np.concatenate([[True], np.diff(at) != x.itemsize]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                    f.seek(int(at[a]))
                    f.write(x[a:b].tobytes())
            f.flush()
            os.fsync(f.fileno())
        return Written(cells)

    def _cells(self, v: pa.Array) -> np.ndarray:
        if pa.types.is_struct(v.type):
            return (v.field(0).to_numpy(zero_copy_only=False) + 1j * v.field(1).to_numpy(zero_copy_only=False)).astype(self.cell)
        if pa.types.is_floating(v.type):
            return v.to_numpy(zero_copy_only=False).astype(self.cell)
        return np.array(v.to_pylist(), self.cell)

    def commit(self, messages: list[Written | None]) -> None:
        with open(self.draft, "r+b") as f:
            f.write(self.header)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.draft, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


def write_ranges(df: DataFrame, path: str, header: bytes, size: int, cell: str = "") -> None:
    """Rows (at, v) as one file. Each task gets a range of places, in order, so that it writes long stretches."""
    df.sparkSession.dataSource.register(ByteRanges)
    dealt = df.select("at", "v").repartitionByRange("at").sortWithinPartitions("at")
    dealt.write.format("byte_ranges").mode("append").options(header=header.hex(), size=str(size), cell=cell).save(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").load(path)
