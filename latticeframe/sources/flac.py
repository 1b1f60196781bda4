"""FLAC frames (RFC 9639): each is read and written by itself, so a file's frames are dealt to many tasks.

A frame begins with a sync code and a checked header; its subframes predict samples by a constant, a
polynomial or a linear filter, and hold what is left as Rice codes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: signature, codes of block sizes, sample rates and sample widths of a frame header.
SIGNATURE = b"fLaC"
BLOCK_SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {k: 256 << k - 8 for k in range(8, 16)}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _crc_table(polynomial: int, width: int) -> list[int]:
    top, mask, out = 1 << width - 1, (1 << width) - 1, []
    for byte in range(256):
        x = byte << width - 8
        for _ in range(8):
            x = (x << 1 ^ polynomial if x & top else x << 1) & mask
        out.append(x)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    x = 0
    for b in data:
        x = CRC8[x ^ b]
    return x


def crc16(data: bytes) -> int:
    x = 0
    for b in data:
        x = (x << 8 & 0xFFFF) ^ CRC16[x >> 8 ^ b]
    return x


class Damaged(ValueError):
    """A frame that isn't one."""


class Short(Damaged):
    """A frame that goes on beyond the bytes at hand."""


@dataclass(frozen=True)
class StreamInfo:
    """What the file's first block says; totals of 0 are unknown."""

    block: int  # of all frames but the last, if they are numbered; 0 if they differ
    rate: int
    channels: int
    bits: int
    samples: int

    def pack(self, frames: tuple[int, int] = (0, 0)) -> bytes:
        """The beginning of a file of these frames, whose shortest and longest have so many bytes; no digest of samples."""
        packed = self.rate << 44 | self.channels - 1 << 41 | self.bits - 1 << 36 | self.samples
        body = struct.pack(">HH", self.block, self.block) + b"".join(n.to_bytes(3, "big") for n in frames) + packed.to_bytes(8, "big") + bytes(16)
        return SIGNATURE + b"\x80" + len(body).to_bytes(3, "big") + body


def read_info(f) -> tuple[StreamInfo, int]:
    """Stream information, and where the frames begin."""
    if f.read(4) != SIGNATURE:
        raise ValueError("not a FLAC file")
    info, last = None, False
    while not last:
        head = f.read(4)
        if len(head) < 4:
            raise ValueError("metadata end early")
        last, kind, size = head[0] >= 128, head[0] & 127, int.from_bytes(head[1:], "big")
        body = f.read(size) if kind == 0 else f.seek(f.tell() + size) and b""
        if kind == 0 and len(body) >= 34:
            low, high = struct.unpack_from(">HH", body)
            packed = int.from_bytes(body[10:18], "big")
            info = StreamInfo(low if low == high else 0, packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1)
    if info is None:
        raise ValueError("no stream information")
    return info, f.tell()


@dataclass(frozen=True)
class Header:
    size: int  # bytes, with checksum
    block: int
    channels: int  # or a code of how two channels are joined
    bits: int
    numbered: bool  # by frames, else by samples
    number: int


def read_header(data: bytes, at: int, info: StreamInfo) -> Header:
    """A frame's header, whose checksum and fields agree."""
    head = data[at : at + 16]
    if len(head) < 6:
        raise Short("header")
    if head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        raise Damaged("sync code")
    size_code, rate_code, channels, width = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not size_code or rate_code == 15 or channels > MID_SIDE or width == 3:
        raise Damaged("reserved value")
    lead = head[4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    if more == 0 and lead >= 0x80 or more > 6:
        raise Damaged("number")
    number, p = lead & (0x7F if not more else (1 << 6 - more) - 1), 5
    extra = {6: 1, 7: 2}.get(size_code, 0)
    end = p + more + extra + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if end >= len(head):
        raise Short("header")
    for b in head[p : p + more]:
        if b & 0xC0 != 0x80:
            raise Damaged("number")
        number = number << 6 | b & 0x3F
    block = int.from_bytes(head[p + more : p + more + extra], "big") + 1 if extra else BLOCK_SIZES[size_code]
    if crc8(head[:end]) != head[end]:
        raise Damaged("checksum of a header")
    count = channels + 1 if channels < LEFT_SIDE else 2
    bits = WIDTHS.get(width, info.bits)
    if count != info.channels or bits != info.bits:
        raise Damaged("other channels or bits than the stream's")
    return Header(end + 1, block, channels, bits, not head[1] & 1, number)


class BitReader:
    """Bits of a stretch of bytes, many at a time."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        self.ones: list[int] | None = None

    def take(self, width: int) -> int:
        return int(self.many(1, width)[0]) if width else 0

    def many(self, count: int, width: int, signed: bool = False) -> np.ndarray:
        """Numbers of equal width."""
        end = self.at + count * width
        if end > len(self.bits):
            raise Short("bits")
        part = self.bits[self.at : end].reshape(count, width).astype(np.int64)
        self.at = end
        out = part @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else np.zeros(count, np.int64)
        return np.where(part[:, 0] == 1, out - (1 << width), out) if signed and width else out

    def unary(self) -> int:
        """Zeros before the next one, which is taken too."""
        found = np.flatnonzero(self.bits[self.at : self.at + 4096])
        if not len(found):
            raise Short("bits")
        self.at += int(found[0]) + 1
        return int(found[0])

    def rice(self, count: int, k: int) -> np.ndarray:
        """Numbers of a unary and a k-bit part, with their signs in the last bit."""
        if self.ones is None:
            ahead = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
            self.ones = np.minimum.accumulate(ahead[::-1])[::-1].tolist()
        ones, p, n, starts, marks = self.ones, self.at, len(self.bits), [], []
        for _ in range(count):
            if p >= n:
                raise Short("bits")
            starts.append(p)
            p = ones[p]
            marks.append(p)
            p += 1 + k
        if p > n:
            raise Short("bits")
        self.at = p
        mark = np.array(marks, np.int64)
        value = mark - np.array(starts, np.int64)
        for j in range(k):
            value = value << 1 | self.bits[mark + 1 + j]
        return value >> 1 ^ -(value & 1)


def _residual(bits: BitReader, block: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or block % parts or block // parts < order:
        raise Damaged("partitions")
    width, out = 4 + method, []
    for p in range(parts):
        k, count = bits.take(width), block // parts - (order if not p else 0)
        out.append(bits.many(count, bits.take(5), signed=True) if k == (1 << width) - 1 else bits.rice(count, k))
    return np.concatenate(out)


def _integrated(start: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Samples whose differences of order len(start) are the residual: summed up once for each order."""
    out = residual
    for order in range(len(start) - 1, -1, -1):
        first = np.diff(start, order)[0]
        out = np.concatenate([[first], first + np.cumsum(out)])
    return out


def _filtered(start: list[int], residual: list[int], weights: list[int], shift: int) -> np.ndarray:
    """Samples predicted by a linear filter of those before, plus the residual."""
    out = list(start)
    backward = weights[::-1]
    n = len(weights)
    for r in residual:
        out.append(r + (sum(map(int.__mul__, backward, out[-n:])) >> shift))
    return np.array(out, np.int64)


def _subframe(bits: BitReader, block: int, width: int) -> np.ndarray:
    if bits.take(1):
        raise Damaged("subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if width <= 0:
        raise Damaged("wasted bits")
    if kind == 0:
        out = np.repeat(bits.many(1, width, signed=True), block)
    elif kind == 1:
        out = bits.many(block, width, signed=True)
    elif 8 <= kind <= 12:
        start = bits.many(min(kind - 8, block), width, signed=True)
        residual = _residual(bits, block, kind - 8)
        out = _integrated(start, residual) if kind > 8 else residual
    elif kind >= 32:
        order = kind - 31
        start = bits.many(order, width, signed=True)
        precision = bits.take(4) + 1
        shift = int(bits.many(1, 5, signed=True)[0])
        if precision == 16 or shift < 0:
            raise Damaged("filter")
        weights = bits.many(order, precision, signed=True).tolist()
        out = _filtered(start.tolist(), _residual(bits, block, order).tolist(), weights, shift)
    else:
        raise Damaged("reserved subframe")
    return out << wasted


def read_frame(data: bytes, at: int, info: StreamInfo) -> tuple[Header, np.ndarray, int]:
    """A frame's header, samples (channel x sample), and where it ends. Both checksums agree."""
    head = read_header(data, at, info)
    likely = at + head.size + 2 * (info.channels * (head.block * (head.bits + 1) // 8 + 64))
    for end in (likely, len(data)) if likely < len(data) else (len(data),):
        try:
            bits = BitReader(data[at + head.size : end])
            side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(head.channels)
            parts = [_subframe(bits, head.block, head.bits + (c == side)) for c in range(info.channels)]
            break
        except Short:
            if end == len(data):
                raise
    ends = at + head.size + -(-bits.at // 8)
    if ends + 2 > len(data):
        raise Short("checksum")
    if crc16(data[at:ends]) != int.from_bytes(data[ends : ends + 2], "big"):
        raise Damaged("checksum of a frame")
    a, b = (parts[0], parts[1]) if len(parts) == 2 else (None, None)
    if head.channels == LEFT_SIDE:
        parts = [a, a - b]
    elif head.channels == SIDE_RIGHT:
        parts = [a + b, b]
    elif head.channels == MID_SIDE:
        double = a << 1 | b & 1
        parts = [(double + b) >> 1, (double - b) >> 1]
    return head, np.stack(parts), ends + 2


#: Bytes that are read beyond a range at first, to see its last frame's end.
BEYOND = 1 << 18


def read_frames(f, size: int, info: StreamInfo, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first sample, samples) of the frames that begin at bytes from ``start`` to ``stop``.

    The first is the first sync code whose header and frame agree with their checksums. After it, a
    frame begins where the one before ends; anything else raises an error.
    """
    beyond = BEYOND
    f.seek(start)
    data = f.read(min(size, stop + beyond) - start)
    at, synced = 0, False
    while True:
        if not synced:
            at = data.find(b"\xff", at)
            if at < 0:
                at = len(data)
        if start + at >= min(stop, size):
            return
        try:
            head, samples, end = read_frame(data, at, info)
        except Short:
            if start + len(data) < size:
                more = f.read(min(beyond, size - start - len(data)))
                data, beyond = data + more, 2 * beyond
                continue
            if synced:
                raise ValueError(f"a frame at byte {start + at} ends early") from None
            at += 1
            continue
        except Damaged as e:
            if synced:
                raise ValueError(f"byte {start + at}: {e}") from None
            at += 1
            continue
        if head.numbered and not info.block:
            raise ValueError("frames are numbered, but their size isn't known")
        yield head.number * info.block if head.numbered else head.number, samples
        at, synced = end, True


# writing


def _fields(values, width: int) -> np.ndarray:
    """Bits of numbers of equal width."""
    v = np.atleast_1d(np.asarray(values, np.int64))
    return (v[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()


def _rice_bits(residual: np.ndarray, k: int) -> np.ndarray:
    u = residual << 1 ^ residual >> 63
    high = u >> k
    sizes = high + 1 + k
    marks = np.cumsum(sizes) - k - 1
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[marks] = 1
    for j in range(k):
        out[marks + 1 + j] = u >> k - 1 - j & 1
    return out


def residual_bits(residual: np.ndarray, block: int, order: int, parts_order: int | None = None) -> np.ndarray:
    """Rice codes in partitions, each with the parameter that makes it shortest, or plain numbers where that is shorter."""
    if parts_order is None:
        parts_order = next(p for p in range(4, -1, -1) if block % (1 << p) == 0 and block >> p > order)
    parts, at, out = 1 << parts_order, 0, []
    for p in range(parts):
        count = block // parts - (order if not p else 0)
        r, at = residual[at : at + count], at + count
        u = r << 1 ^ r >> 63
        costs = [int((u >> k).sum()) + count * (1 + k) for k in range(31)]
        k, plain = int(np.argmin(costs)), max(1, int(np.abs(r).max(initial=0)).bit_length() + 1)
        if count * plain + 5 < costs[k] and plain < 32:
            out += [_fields(31, 5), _fields(plain, 5), _fields(r, plain) if count else _fields([], 1)]
        else:
            out += [_fields(k, 5), _rice_bits(r, k)]
    return np.concatenate([_fields(1, 2), _fields(parts_order, 4), *out])


def subframe_bits(x: np.ndarray, width: int, kind: str = "", order: int = 0, weights: list[int] | None = None, shift: int = 0, precision: int = 15) -> np.ndarray:
    """A subframe of samples: of the kind that is asked for, else a constant, or the polynomial with the least residual."""
    if not kind:
        kind = "constant" if (x == x[0]).all() else "fixed"
        sums = [int(np.abs(np.diff(x, k)).sum()) for k in range(min(5, len(x)))]
        order = int(np.argmin(sums))
    wasted = 0
    if kind != "constant" and x.any():
        together = int(np.bitwise_or.reduce(x))
        wasted = min((together & -together).bit_length() - 1, width - 1)
    x, width = x >> wasted, width - wasted
    code = {"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind]
    head = [_fields(code, 7), _fields(bool(wasted), 1), *([_fields(1, wasted)] if wasted else [])]
    if kind == "constant":
        return np.concatenate([*head, _fields(x[:1], width)])
    if kind == "verbatim":
        return np.concatenate([*head, _fields(x, width)])
    if kind == "fixed":
        return np.concatenate([*head, _fields(x[:order], width), residual_bits(np.diff(x, order), len(x), order)])
    predicted = sum(w * x[order - 1 - j : len(x) - 1 - j] for j, w in enumerate(weights)) >> shift
    filters = [_fields(precision - 1, 4), _fields(shift, 5), _fields(weights, precision)]
    return np.concatenate([*head, _fields(x[:order], width), *filters, residual_bits(x[order:] - predicted, len(x), order)])


def write_frame(x: np.ndarray, number: int, bits: int, join: int | None = None, numbered: bool = True, **how) -> bytes:
    """A frame of samples (channel x sample). Two channels are joined as mid and side if that is shorter."""
    block = x.shape[1]
    code = len(x) - 1 if join is None else join
    side = None
    if len(x) == 2:
        left, right = x
        if join is None and np.abs(np.diff(left - right)).sum() < np.abs(np.diff(right)).sum():
            code = MID_SIDE
        x, side = {LEFT_SIDE: (np.stack([left, left - right]), 1), SIDE_RIGHT: (np.stack([left - right, right]), 0), MID_SIDE: (np.stack([left + right >> 1, left - right]), 1)}.get(code, (x, None))
    if number < 0x80:
        coded = bytes([number])
    else:
        more = next(n for n in range(1, 7) if number < 1 << 5 * n + 6)
        lead = (0xFF << 7 - more & 0xFF) | number >> 6 * more
        coded = bytes([lead, *(0x80 | number >> 6 * k & 0x3F for k in range(more - 1, -1, -1))])
    width = next(k for k, v in WIDTHS.items() if v == bits)
    head = bytes([0xFF, 0xF8 | (not numbered), 7 << 4, code << 4 | width << 1]) + coded + struct.pack(">H", block - 1)
    head += bytes([crc8(head)])
    body = np.packbits(np.concatenate([subframe_bits(c, bits + (k == side), **how) for k, c in enumerate(x)])).tobytes()
    return head + body + struct.pack(">H", crc16(head + body))
