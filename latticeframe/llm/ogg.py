"""Ogg media columns: texts stored as 8-bit samples in Ogg streams, read back and measured.

Pages follow the public Ogg framing (RFC 3533): capture pattern, flags, granule position, serial,
sequence number, checksum (polynomial 0x04c11db7, not reflected, initial value 0) and lacing
values. A column's stream multiplexes two logical streams: unsigned 8-bit samples, and a comment
stream with the payload's length before padding.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded

SAMPLE_RATE = 8000
PACKET_SAMPLES = 8192
PAD = 64
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = (1 << 64) - 1
_HEAD = struct.Struct("<4sBBQIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32. It is zlib's with the bits of every byte, and of the result, in reverse."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream. Packets are (body, granule position at their end); the first has a page of its own."""
    number, lacing, body, granule, continued = 0, bytearray(), bytearray(), NO_GRANULE, False

    def page(last: bool) -> bytes:
        flags = CONTINUED * continued | FIRST * (number == 0) | LAST * last
        head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
        whole = bytearray(head + body)
        whole[22:26] = page_checksum(bytes(whole)).to_bytes(4, "little")
        return bytes(whole)

    for k, (data, position) in enumerate(packets):
        at, left = 0, len(data) // 255 + 1
        while left:
            if len(lacing) == 255:
                yield page(False)
                number, lacing, body, granule, continued = number + 1, bytearray(), bytearray(), NO_GRANULE, at > 0
            take = min(left, 255 - len(lacing))
            left -= take
            size = take * 255 if left else (take - 1) * 255 + len(data) % 255
            lacing += b"\xff" * (take if left else take - 1)
            if not left:
                lacing.append(len(data) % 255)
                granule = position
            body += data[at : at + size]
            at += size
        if k == 0 and len(packets) > 1:
            yield page(False)
            number, lacing, body, granule, continued = 1, bytearray(), bytearray(), NO_GRANULE, False
    yield page(True)


def write_media(payload: bytes, n_bytes: int) -> bytes:
    """An Ogg stream of ``payload`` as samples, multiplexed with its comment stream. Equal input, equal output."""
    serial = zlib.crc32(payload)
    head = struct.pack("<8sIBB", b"U8 PCM\0\1", SAMPLE_RATE, 1, 8)
    packets = [(head, 0)]
    for at in range(0, len(payload), PACKET_SAMPLES):
        part = payload[at : at + PACKET_SAMPLES]
        packets.append((part, at + len(part)))
    samples = _pages(serial, packets)
    comment = _pages(serial ^ 1, [(b"comment\0", 0), (b"n_bytes=%d" % n_bytes, 0)])
    # first pages of all streams come before any other page
    first = [next(samples), next(comment)]
    return b"".join([*first, *comment, *samples])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing, body) of each page whose checksum holds; what isn't a page is skipped."""
    at = media.find(b"OggS")
    while 0 <= at and at + 27 <= len(media):
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        stop = start + sum(lacing)
        page = media[at:stop]
        if version or stop > len(media) or len(lacing) < segments or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            at = media.find(b"OggS", at + 1)
            continue
        yield serial, number, flags, granule, lacing, media[start:stop]
        at = stop if media[stop : stop + 4] == b"OggS" else media.find(b"OggS", stop)


def read_media(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """The logical streams by serial: their packets, each with the granule position of its page if it is the last to end there.

    Packets that miss a page are left out.
    """
    streams: dict[int, list[tuple[bytes, int | None]]] = {}
    partial: dict[int, bytearray | None] = {}
    follows: dict[int, int] = {}
    for serial, number, flags, granule, lacing, body in read_pages(media):
        packets = streams.setdefault(serial, [])
        held = partial.get(serial) if follows.get(serial) == number else None
        held = held if flags & CONTINUED else bytearray()
        follows[serial] = number + 1
        at, ended = 0, None
        # lengths of packets: runs of 255 and the value that ends them
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                if held is not None:
                    packets.append((bytes(held) + body[at : at + size], None))
                    ended = len(packets) - 1
                held = bytearray()
                at, size = at + size, 0
        if size and held is not None:
            held += body[at : at + size]
        elif size == 0 and (not lacing or lacing[-1] < 255):
            held = bytearray()
        partial[serial] = held
        if ended is not None and granule != NO_GRANULE:
            packets[ended] = (packets[ended][0], granule)
    return streams


def timestamps(packets: list[tuple[bytes, int | None]], rate: int) -> list[float]:
    """Seconds at which each packet of 8-bit samples ends, from granule positions; those between count back from the next."""
    out = [0.0] * len(packets)
    position = None
    for k in range(len(packets) - 1, -1, -1):
        position = packets[k][1] if packets[k][1] is not None else position
        out[k] = (position or 0) / rate
        position = None if position is None else position - len(packets[k][0])
    return out


def media_row(text: str | None) -> tuple:
    """What ``ogg_media`` returns for a text: media first."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(PAD, -(-len(raw) // PAD) * PAD)
    media = write_media(raw + bytes(size - len(raw)), len(raw))
    streams = list(read_media(media).values())
    samples = next(s for s in streams if s[0][0].startswith(b"U8 PCM"))
    comment = next(s for s in streams if s[0][0].startswith(b"comment"))
    rate = struct.unpack_from("<I", samples[0][0], 8)[0]
    back = b"".join([p for p, _ in samples[1:]])
    n_bytes = int(comment[1][0].partition(b"=")[2])
    values = np.frombuffer(back, np.uint8)
    mean, rms = values.mean(), float(np.sqrt(np.square(values, dtype=np.uint32).mean(dtype=np.float64)))
    crossings = int(np.count_nonzero((values[1:] < 128) != (values[:-1] < 128)))
    ends = timestamps(samples, rate)
    feature = f"seconds={ends[-1]:.6f};packets={len(samples) - 1};mean={mean:.6f};rms={rms:.6f};crossings={crossings};peak={int(values.max())}"
    return media, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature


def ogg_media(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Stores every text as Ogg media and reads features from the stored bytes.

    Takes ``doc_id`` and ``text`` (null: empty) and ignores other columns. The payload is the
    text's UTF-8 with bytes 0 up to a positive multiple of 64. Returns for each row doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and with ``keep``
    media binary. All but media_bytes, media_sha256 and media come from packets that were
    reassembled from checked pages. The work is row by row without a shuffle; repeated rows and
    null ids are returned as they come, an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = list(zip(*map(media_row, batch.column(1).slice(at, 256).to_pylist()), strict=True))
                kinds = pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()
                arrays = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
                ids = batch.column(0).slice(at, 256)
                yield pa.RecordBatch.from_arrays([ids, *arrays[1:], *arrays[: int(keep)]], NAMES[: 8 + keep])

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(bounded(run), kinds + ", media binary" * keep)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
