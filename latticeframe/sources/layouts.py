"""Where the cells of an array file lie: headers of .csn, .npy, WAV and FLAC files, read without their payload."""

from __future__ import annotations

import io
import math
import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from ..tensor import COMPLEX, MAX_RANK, REAL, STRING
from .flac import StreamInfo, read_info

# Fixed values of the .csn format, little-endian: signature, version, codes of element types, and the header
# (signature, major, minor, type, rank, cells, eight extents, payload bytes). A string is its length and its bytes.
CSN_SIGNATURE, CSN_VERSION = b"CSDN", (1, 0)
CSN_TYPES = {1: REAL, 2: COMPLEX, 3: STRING}
CSN_HEADER = struct.Struct("<4sHHIIQ8IQ")
CSN_LENGTH = struct.Struct("<I")

#: A WAV sample of 24 bits, for which NumPy has no type.
INT24 = "int24"


@dataclass(frozen=True)
class Layout:
    """A payload of equally wide cells from byte ``at`` on, or of strings with their lengths before them, or of FLAC frames."""

    kind: int
    shape: tuple[int, ...]
    cell: str  # a NumPy type, INT24, or empty for strings with lengths
    at: int
    bytes: int
    order: str = "C"
    zero: float = 0.0  # a real cell is (number - zero) / scale
    scale: float = 1.0
    rate: int | None = None
    frames: StreamInfo | None = None

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def width(self) -> int:
        return 3 if self.cell == INT24 else np.dtype(self.cell).itemsize if self.cell else 0

    def values(self, raw: bytes) -> np.ndarray:
        """Cells of payload bytes, as floats, complex numbers or strings."""
        if self.cell == INT24:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
        else:
            x = np.frombuffer(raw, self.cell)
        if self.kind == STRING:
            return np.char.decode(x, "utf-8") if x.dtype.kind == "S" else x
        if self.kind == COMPLEX:
            return x.astype(complex)
        return (x.astype(float) - self.zero) / self.scale

    def places(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Index columns of the cells from ``start`` to ``stop`` in the file's order."""
        return np.unravel_index(np.arange(start, stop), self.shape, order=self.order)


def csn_header(kind: int, shape: tuple[int, ...], payload: int) -> bytes:
    code = next(k for k, v in CSN_TYPES.items() if v == kind)
    return CSN_HEADER.pack(CSN_SIGNATURE, *CSN_VERSION, code, len(shape), math.prod(shape), *shape, *[0] * (MAX_RANK - len(shape)), payload)


def csn_layout(f: BinaryIO, size: int) -> Layout:
    head = f.read(CSN_HEADER.size)
    if len(head) < CSN_HEADER.size or head[:4] != CSN_SIGNATURE:
        raise ValueError("not a .csn file: its signature or header is damaged")
    _, major, minor, code, rank, cells, *extents, payload = CSN_HEADER.unpack(head)
    if (major, minor) != CSN_VERSION:
        raise ValueError(f"version {major}.{minor}")
    if code not in CSN_TYPES:
        raise ValueError(f"element type {code}")
    if not 1 <= rank <= MAX_RANK:
        raise ValueError(f"rank {rank}")
    kind, shape = CSN_TYPES[code], tuple(extents[:rank])
    if cells != math.prod(shape):
        raise ValueError(f"{cells} cells of shape {shape}")
    cell = {REAL: "<f8", COMPLEX: "<c16", STRING: ""}[kind]
    least = cells * (np.dtype(cell).itemsize if cell else CSN_LENGTH.size)
    if payload < least or cell and payload != least or size != CSN_HEADER.size + payload:
        raise ValueError(f"{payload} payload bytes for {cells} cells in a file of {size} bytes")
    return Layout(kind, shape, cell, CSN_HEADER.size, payload)


def npy_header(cell: str, shape: tuple[int, ...]) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": cell, "fortran_order": False, "shape": shape})
    return out.getvalue()


def npy_layout(f: BinaryIO, size: int) -> Layout:
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ValueError(f"version {version}")
    # version 3 is 2 with UTF-8 names, which only structured types have
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    kinds = {"b": REAL, "i": REAL, "u": REAL, "f": REAL, "c": COMPLEX, "U": STRING, "S": STRING}
    if dtype.kind not in kinds or not 1 <= len(shape) <= MAX_RANK:
        raise ValueError(f"type {dtype}, shape {shape}")
    payload = math.prod(shape) * dtype.itemsize
    if size - f.tell() < payload:
        raise ValueError(f"{size - f.tell()} payload bytes of {payload}")
    return Layout(kinds[dtype.kind], tuple(shape), dtype.str, f.tell(), payload, "F" if fortran else "C")


def wav_header(channels: int, frames: int, rate: int) -> bytes:
    """Of 32-bit floats. Sizes are 32-bit, so a file ends at 4 GB."""
    body = channels * frames * 4
    form = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
    head = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, frames) + b"data"
    if len(head) + 4 + body >= 2**32:
        raise ValueError(f"{body} bytes of sound don't fit a WAV file")
    return b"RIFF" + struct.pack("<I", len(head) + 4 + body) + head + struct.pack("<I", body)


def wav_layout(f: BinaryIO, size: int) -> Layout:
    """Samples (channel x frame): frames follow each other, so the file's order is that of columns."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    form, at, length = None, None, 0
    while f.tell() + 8 <= size:
        name, n = struct.unpack("<4sI", f.read(8))
        begins = f.tell()
        if name == b"fmt ":
            body = f.read(min(n, 40))
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE:  # extensible: the kind is in the sub-format
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            at, length = begins, min(n, size - begins)
        f.seek(begins + n + n % 2)
    if form is None or at is None:
        raise ValueError("no format or data chunk")
    kind, channels, rate, _, _, bits = form
    known = {(1, 8): ("u1", 128.0), (1, 16): ("<i2", 0.0), (1, 24): (INT24, 0.0), (1, 32): ("<i4", 0.0), (3, 32): ("<f4", 0.0), (3, 64): ("<f8", 0.0)}
    if (kind, bits) not in known or not channels:
        raise ValueError(f"WAV kind {kind}, {bits} bits, {channels} channels")
    cell, zero = known[kind, bits]
    frames = length // (bits // 8 * channels)
    scale = 1.0 if kind == 3 else 2.0 ** (bits - 1)
    return Layout(REAL, (channels, frames), cell, at, frames * channels * bits // 8, "F", zero, scale, rate)


def flac_layout(f: BinaryIO, size: int) -> Layout:
    """Samples (channel x frame); an unknown number of samples counts as 0."""
    info, at = read_info(f)
    return Layout(REAL, (info.channels, info.samples), "", at, size - at, scale=2.0 ** (info.bits - 1), rate=info.rate, frames=info)


LAYOUTS = {".csn": csn_layout, ".npy": npy_layout, ".wav": wav_layout, ".flac": flac_layout}
