import hashlib
import zlib

import pytest
from latticeframe.llm.ogg import ogg_media, page_checksum, read_media, read_pages, timestamps, write_media

TEXTS = [None, "", "a", "ü😀" * 40, "x" * 64, "y" * 65, "lorem ipsum " * 40_000, "\x00" * 255 * 33]


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_rows_equal_the_payload(spark):
    rows = [(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, "a", "m"), (2, "a", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = ogg_media(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a" if r.doc_id is None else TEXTS[r.doc_id]
        want = payload(text)
        assert r.n_bytes == len((text or "").encode()) and r.payload_bytes == len(want)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.feature.startswith(f"seconds={len(want) / 8000:.6f};")
    by_text = {(r.payload_sha256, r.media_sha256, r.feature) for r in got if r.doc_id in (None, 2)}
    assert len(by_text) == 1
    assert ogg_media(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 8192, 8256, 255 * 255 * 3, 1 << 18])
def test_round_trip_and_timestamps(size):
    data = bytes(i * 7 % 256 for i in range(size))
    streams = list(read_media(write_media(data, size)).values())
    assert len(streams) == 2
    samples = next(s for s in streams if s[0][0].startswith(b"U8 PCM"))
    assert b"".join(p for p, _ in samples[1:]) == data
    ends = timestamps(samples, 8000)[1:]
    at = 0
    for (p, _), end in zip(samples[1:], ends, strict=True):
        at += len(p)
        assert end == at / 8000


def test_checksum_by_the_book():
    def slow(page):
        crc = 0
        for byte in page:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        return crc

    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert page_checksum(data) == slow(data)


def test_a_damaged_page_is_skipped():
    data = bytes(range(256)) * 2048
    media = bytearray(write_media(data, len(data)))
    whole = len(list(read_pages(bytes(media))))
    media[len(media) // 2] ^= 1
    assert len(list(read_pages(bytes(media)))) == whole - 1
    samples = next(s for s in read_media(bytes(media)).values() if s[0][0].startswith(b"U8 PCM"))
    assert 0 < sum(len(p) for p, _ in samples[1:]) < len(data)
