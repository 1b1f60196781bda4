"""FLAC frames of all forms, against those that the tests write, the format's published example and damaged files."""

import io
import tempfile
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticeframe.operators.creation import fromarray
from latticeframe.sources import files, flac, ranges
from latticeframe.sources.flac import LEFT_SIDE, MID_SIDE, SIDE_RIGHT, StreamInfo, read_frame, write_frame
from latticeframe.tensor import Tensor


def back(x, bits, join=None, numbered=True, number=5, **how):
    made = write_frame(x, number, bits, join, numbered, **how)
    head, got, end = read_frame(b"y" + made + b"zz", 1, StreamInfo(x.shape[1], 8000, len(x), bits, 0))
    assert (head.number, head.numbered, end) == (number, numbered, len(made) + 1)
    np.testing.assert_array_equal(got, x)
    return len(made)


def walk(seed, channels, n, bits):
    top = 2 ** (bits - 1)
    return np.clip(np.cumsum(np.random.default_rng(seed).integers(-9, 10, (channels, n)), 1), -top, top - 1)


@pytest.mark.parametrize("bits", [8, 12, 16, 20, 24, 32])
@pytest.mark.parametrize("channels", [1, 2, 3, 8])
def test_frames_of_all_forms(bits, channels):
    top = 2 ** (bits - 1)
    for n in (1, 2, 5, 17, 192, 576, 4096):
        x = walk(n, channels, n, bits)
        back(np.random.default_rng(n).integers(-top, top, (channels, n)), bits)
        back(x, bits, number=2**31 - 1)
        back(np.full((channels, n), -top), bits, numbered=False, number=2**36 - 1)
        back(x, bits, kind="verbatim")
        if n > 40:
            back(x << 2 if bits > 12 else x, bits)
            for order in range(5):
                back(x, bits, kind="fixed", order=order)
            back(x, bits, kind="lpc", order=2, weights=[1900, -880], shift=10)
            back(x, bits, kind="lpc", order=32, weights=list(range(-16, 16)), shift=12)
            back(x, bits, kind="lpc", order=1, weights=[1], shift=0, precision=2)
        if channels == 2:
            for join in (1, LEFT_SIDE, SIDE_RIGHT, MID_SIDE):
                back(x, bits, join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**15), 2**15 - 1), min_size=1, max_size=60), st.integers(0, 2**36 - 1))
def test_any_samples(values, number):
    back(np.array([values]), 16, number=number, numbered=number < 2**31)


def test_smooth_sounds_get_smaller():
    x = np.round(20000 * np.sin(np.arange(4096) / 30)).astype(np.int64)[None]
    assert back(x, 16) < 0.5 * back(x, 16, kind="verbatim")


#: The first example of the format's description: two channels of one sample.
EXAMPLE = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")


def test_published_example():
    samples, rate = files.parse_sound(EXAMPLE)
    assert rate == 44100 and (samples * 2**15).tolist() == [[25588], [10416]]


def stream(x, bits=16, block=64, numbered=True):
    info = StreamInfo(block if numbered else 0, 8000, len(x), bits, x.shape[1])
    frames = [write_frame(x[:, k : k + block], k // block if numbered else k, bits, None, numbered) for k in range(0, x.shape[1], block)]
    extra = b"\x04" + (9).to_bytes(3, "big") + b"\xff\xf8 vendor"  # a block of comments that looks like a frame
    head = info.pack()
    return head[:4] + b"\x00" + head[5:] + b"\x84" + extra[1:] + b"".join(frames)


@pytest.mark.parametrize("numbered", [True, False])
@pytest.mark.parametrize("step", [7, 100, 1000, 10**6])
def test_ranges_meet(numbered, step, monkeypatch):
    """Whatever the ranges, each frame is read by one of them; windows grow as frames ask for it."""
    monkeypatch.setattr(flac, "BEYOND", 16)
    x = walk(3, 2, 1000, 16)
    content = stream(x, numbered=numbered)
    f = io.BytesIO(content)
    info, at = flac.read_info(f)
    got = [p for a in range(at, len(content), step) for p in flac.read_frames(f, len(content), info, a, min(a + step, len(content)))]
    assert [first for first, _ in got] == list(range(0, 1000, 64))
    np.testing.assert_array_equal(np.concatenate([s for _, s in got], 1), x)


def test_damaged_files():
    x = walk(4, 1, 500, 16)
    good = stream(x)
    for content, says in (
        (b"fLaX" + good[4:], "not a|RIFF|WAV"),
        (good[:20], "metadata|information|struct|end early"),
        (good[:-1], "ends early"),
        (good[:-40] + bytes([good[-40] ^ 16]) + good[-39:], "checksum|byte"),
    ):
        with pytest.raises(Exception, match=says):
            files.parse_sound(content)


@pytest.mark.parametrize("bits", [8, 16, 24])
def test_arrays_through_spark(spark, bits, monkeypatch):
    """One file is written and read by several tasks; channels that end early are 0, as are cells without rows."""
    monkeypatch.setattr(files, "BLOCK", 256)
    monkeypatch.setattr(files, "SEGMENT_CELLS", 3)
    monkeypatch.setattr(ranges, "SPLIT_BYTES", 700)
    top = 2 ** (bits - 1)
    x = walk(5, 2, 3000, bits) / top
    x[1, 2500:] = 0
    x[:, 512:768] = 0
    x[0, 0], x[1, 1] = 2.0, -2.0  # beyond the range
    path = str(Path(tempfile.mkdtemp(prefix="spark-")) / "a.flac")
    t = fromarray(spark, x)
    files.save_flac(Tensor(t.df.filter("v <> 0").repartition(7), 2, (), (2, 3000)), path, 44100, bits)
    x[0, 0], x[1, 1] = (top - 1) / top, -1.0
    found = files.load_arrays(spark, path)
    got = np.full((2, 3000), np.nan)
    rows = found.df.collect()
    for r in rows:
        got[r.i0, r.i1] = r.v
    assert len(rows) == 6000
    np.testing.assert_array_equal(got, x)
    whole, rates = files.load_audio(spark, path)
    assert rates.first().rate == 44100 and whole.df.count() == 6000
    info, at = flac.read_info(open(path, "rb"))
    assert (info.channels, info.samples, info.bits, info.block) == (2, 3000, bits, 256)
