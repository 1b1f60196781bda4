"""Array files (.csn, NumPy, WAV, FLAC) and Parquet, written and read by many tasks.

One file is read and written by ranges of bytes (``ranges.py``); the array doesn't pass through the
driver. ``load_npy`` and ``load_audio`` are for many small files on any file system that Spark
reads: a file is parsed in one task, and cells come out as rows keyed by the file's path.
"""

from __future__ import annotations

import io
import json
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import complexes
from ..operators.creation import toarray
from ..tensor import COMPLEX, REAL, STRING, Tensor
from . import flac
from .layouts import CSN_HEADER, csn_header, npy_header, wav_header
from .ranges import read_arrays, write_ranges


def parse_npy(content: bytes) -> np.ndarray:
    """A .npy file of numbers or strings; pickled objects are refused."""
    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.dtype.kind in "biu":
        a = a.astype(float)
    if a.dtype.kind not in "fcU":
        raise ValueError(f"type {a.dtype}")
    return a


def parse_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (channel x frame) from -1 to 1, and the rate, of PCM or float WAV bytes."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE:  # extensible: the kind is in the sub-format
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None:
        raise ValueError("no format chunk")
    kind, channels, rate, _, _, bits = form
    if kind == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif kind == 1 and bits == 24:
        raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / 2**23
    elif kind == 1:
        x = np.frombuffer(data, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    else:
        raise ValueError(f"WAV kind {kind}, {bits} bits")
    return x[: len(x) // channels * channels].reshape(-1, channels).T, rate


def parse_sound(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (channel x frame) from -1 to 1, and the rate, of WAV or FLAC bytes."""
    if content[:4] != flac.SIGNATURE:
        return parse_wav(content)
    f = io.BytesIO(content)
    info, at = flac.read_info(f)
    parts = [x for _, x in flac.read_frames(f, len(content), info, at, len(content))]
    return np.concatenate([np.zeros((info.channels, 0)), *parts], axis=1) / 2.0 ** (info.bits - 1), info.rate


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A WAV file of 32-bit floats, one channel for each row."""
    samples = np.atleast_2d(samples).astype("<f4")
    return wav_header(*samples.shape, rate) + samples.T.tobytes()


def _cells(spark: SparkSession, path: str, rank: int, parse, kind: int) -> DataFrame:
    value = {REAL: "v double", COMPLEX: f"v {complexes.TYPE}", STRING: "v string"}[kind]

    def run(batches):
        for frame in batches:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                a = parse(bytes(content))
                if a.ndim != rank:
                    raise ValueError(f"{name} has rank {a.ndim}")
                flat = a.ravel()
                for start in range(0, len(flat), 1 << 16):
                    part = flat[start : start + (1 << 16)]
                    index = np.unravel_index(np.arange(start, start + len(part)), a.shape)
                    out = pd.DataFrame({"path": name} | {f"i{k}": x for k, x in enumerate(index)})
                    out["v"] = [{"re": z.real, "im": z.imag} for z in part] if kind == COMPLEX else part.astype(str if kind == STRING else float)
                    yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(["path string", *(f"i{k} long" for k in range(rank)), value]))


def load_npy(spark: SparkSession, path: str, rank: int, kind: int = REAL) -> Tensor:
    """All .npy files of a path, arrays keyed by ``path``."""
    return Tensor(_cells(spark, path, rank, parse_npy, kind), rank, ("path",))


def load_audio(spark: SparkSession, path: str) -> tuple[Tensor, DataFrame]:
    """All WAV and FLAC files of a path (channel x frame, keyed by ``path``), and their rates (path, rate)."""

    def rates(batches):
        for frame in batches:
            yield pd.DataFrame({"path": frame["path"], "rate": [parse_sound(bytes(c))[1] for c in frame["content"]]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return Tensor(_cells(spark, path, 2, lambda c: parse_sound(c)[0], REAL), 2, ("path",)), files.mapInPandas(rates, "path string, rate long")


def npy_bytes(t: Tensor) -> bytes:
    """An array as a .npy file, for arrays that fit the driver."""
    out = io.BytesIO()
    a = toarray(t)
    np.save(out, a.astype(str) if t.kind == STRING else a, allow_pickle=False)
    return out.getvalue()


def audio_bytes(t: Tensor, rate: int) -> bytes:
    return wav_bytes(toarray(t), rate)


def _single(t: Tensor) -> tuple[int, ...]:
    if t.keys:
        raise ValueError("one array a file, not one for each key")
    return t.shape


#: Strings whose lengths are summed together; their number is one for each so many cells.
SEGMENT_CELLS = 1 << 16


def _dense(t: Tensor) -> DataFrame:
    """(flat, v) of strings, with empty ones in cells that have no row."""
    cells = t.df.select(t.flat().alias("flat"), "v")
    if t.df.count() == math.prod(t.shape):
        return cells
    every = t.df.sparkSession.range(math.prod(t.shape)).withColumnRenamed("id", "flat")
    return every.join(cells, "flat", "left").select("flat", F.coalesce("v", F.lit("")).alias("v"))


def save_csn(t: Tensor, path: str) -> None:
    """One .csn file; cells that have no row are 0, or empty strings.

    Numbers have fixed places. Strings begin where those before them end: lengths are summed by
    segments of the flat order, and running sums within a segment begin at its first byte.
    """
    shape = _single(t)
    if t.kind != STRING:
        cell, width = ("<f8", 8) if t.kind == REAL else ("<c16", 16)
        payload = math.prod(shape) * width
        rows = t.df.select((t.flat() * width + CSN_HEADER.size).alias("at"), "v")
        write_ranges(rows, path, csn_header(t.kind, shape, payload), CSN_HEADER.size + payload, cell)
        return
    digits = F.lpad(F.hex(F.octet_length("body").cast("long")), 8, "0")
    length = F.unhex(F.concat(*(F.substring(digits, k, 2) for k in (7, 5, 3, 1))))  # little-endian
    cells = _dense(t).select("flat", F.encode("v", "UTF-8").alias("body")).select("flat", F.concat(length, "body").alias("v"))
    rows, end = _one_after_another(cells, "flat", CSN_HEADER.size)
    write_ranges(rows, path, csn_header(STRING, shape, end - CSN_HEADER.size), end)


def _one_after_another(df: DataFrame, order: str, first: int) -> tuple[DataFrame, int]:
    """(at, v) of rows (order, v) of bytes that follow each other from place ``first`` on, and where they end.

    Lengths are summed by segments of the order, whose sums (one for each ``SEGMENT_CELLS`` rows) the
    driver adds up; running sums within a segment go from its first byte.
    """
    sized = df.select(F.floor(F.col(order) / SEGMENT_CELLS).alias("segment"), order, "v", F.octet_length("v").cast("long").alias("bytes"))
    totals = sorted(sized.groupBy("segment").agg(F.sum("bytes").alias("bytes")).collect())
    ends = np.cumsum([first, *(r.bytes for r in totals)]).tolist()
    starts = df.sparkSession.createDataFrame([(r.segment, at) for r, at in zip(totals, ends, strict=False)], "segment long, first long")
    before = F.sum("bytes").over(Window.partitionBy("segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(starts), "segment")
    return placed.select((F.col("first") + F.col("before")).alias("at"), "v"), ends[-1]


#: Samples of each channel in a FLAC frame.
BLOCK = 4096


def save_flac(t: Tensor, path: str, rate: int, bits: int = 16) -> None:
    """A FLAC file of samples (channel x frame) from -1 to 1, rounded to ``bits`` (8, 12, 16, 20, 24); cells without a row are 0.

    Frames are encoded where their blocks of samples are, and written to their places.
    """
    t.need(REAL)
    channels, samples = _single(t)
    if not 1 <= channels <= 8:
        raise ValueError(f"{channels} channels")
    top = 2 ** (bits - 1)
    whole = F.greatest(F.lit(-top), F.least(F.lit(top - 1), F.round(F.col("v") * top))).cast("long")
    cells = t.df.select(F.floor(F.col("i1") / BLOCK).alias("block"), "i0", F.pmod("i1", F.lit(BLOCK)).alias("i1"), whole.alias("v"))

    def encode(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        x = np.zeros((channels, min(BLOCK, samples - block * BLOCK)), np.int64)
        x[table["i0"].to_numpy(), table["i1"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"block": [block], "v": pa.array([flac.write_frame(x, block, bits)], pa.binary())})

    # every block has a frame, with or without rows
    every = t.df.sparkSession.range(-(-samples // BLOCK)).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("i0"), F.lit(0).cast("long").alias("i1"), F.lit(None).cast("long").alias("v"))
    filled = cells.unionByName(every.join(cells.select("block").distinct(), "block", "left_anti").withColumn("v", F.lit(0).cast("long")))
    frames = filled.groupBy("block").applyInArrow(encode, "block long, v binary").persist()
    try:
        sizes = frames.agg(F.min(F.octet_length("v")).alias("least"), F.max(F.octet_length("v")).alias("most")).first()
        header = flac.StreamInfo(BLOCK, rate, channels, bits, samples).pack((sizes.least or 0, sizes.most or 0))
        rows, end = _one_after_another(frames, "block", len(header))
        write_ranges(rows, path, header, end)
    finally:
        frames.unpersist()


def save_npy(t: Tensor, path: str) -> None:
    """One .npy file of doubles, complex numbers or strings as wide as the longest."""
    shape = _single(t)
    longest = (t.df.agg(F.max(F.length("v"))).first()[0] or 1) if t.kind == STRING else 0
    cell = {REAL: "<f8", COMPLEX: "<c16", STRING: f"<U{max(1, longest)}"}[t.kind]
    header, width = npy_header(cell, shape), np.dtype(cell).itemsize
    write_ranges(t.df.select((t.flat() * width + len(header)).alias("at"), "v"), path, header, len(header) + math.prod(shape) * width, cell)


def save_audio(t: Tensor, path: str, rate: int) -> None:
    """A WAV file (channel x frame) of 32-bit floats."""
    t.need(REAL)
    if t.ndim > 2:
        raise ValueError(f"rank {t.ndim}")
    shape = _single(t) if t.ndim == 2 else (1, *_single(t))
    header = wav_header(*shape, rate)
    channel, frame = (F.col("i0"), F.col("i1")) if t.ndim == 2 else (F.lit(0), F.col("i0"))
    rows = t.df.select(((frame * shape[0] + channel) * 4 + len(header)).alias("at"), "v")
    write_ranges(rows, path, header, len(header) + math.prod(shape) * 4, "<f4")


def load_arrays(spark: SparkSession, path: str) -> Tensor:
    """The .csn, .npy, WAV and FLAC files of a path, arrays keyed by ``path``, whose rank and type are read from their headers."""
    df = read_arrays(spark, path)
    return Tensor(df, len(df.columns) - 2, ("path",))


def save(t: Tensor, path: str) -> None:
    """An array of any size: a .csn or .npy file if the path ends so, else cells as Parquet, and its shape beside them."""
    if path.endswith(".csn") or path.endswith(".npy"):
        return save_csn(t, path) if path.endswith(".csn") else save_npy(t, path)
    spark = t.df.sparkSession
    t.df.write.mode("overwrite").parquet(f"{path}/cells")
    about = json.dumps({"rank": t.ndim, "keys": t.keys, "extents": None if t.extents is None else list(t.extents), "set": t.is_set})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Tensor:
    """What ``save`` wrote."""
    if path.endswith(".csn") or path.endswith(".npy"):
        found = load_arrays(spark, path)
        return Tensor(found.df.drop("path"), found.ndim)
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    extents = about["extents"]
    return Tensor(spark.read.parquet(f"{path}/cells"), about["rank"], tuple(about["keys"]), None if extents is None else tuple(extents), about["set"])


def channels(t: Tensor) -> DataFrame:
    """(i1, c0, c1, ...): a column for each channel."""
    return t.df.groupBy("i1").agg(*(F.max(F.when(F.col("i0") == k, F.col("v"))).alias(f"c{k}") for k in range(t.shape[0])))
