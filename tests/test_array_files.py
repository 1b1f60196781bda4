"""Files written and read by ranges of bytes, damaged ones, and many tasks for one file."""

import io
import struct
import tempfile
from pathlib import Path

import numpy as np
import pytest
from latticeframe.operators.creation import fromarray
from latticeframe.sources import files, ranges
from latticeframe.sources.layouts import csn_header, csn_layout
from latticeframe.tensor import COMPLEX, REAL, STRING, Tensor


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def cells(t):
    axes = [f"i{k}" for k in range(t.ndim)]
    return {tuple(r[a] for a in axes): complex(r.v.re, r.v.im) if t.kind == COMPLEX else r.v for r in t.df.collect()}


ARRAYS = [np.arange(60.0).reshape(3, 4, 5) - 7.5, np.array([[1 + 2j, 3 - 4j, np.inf]]), np.array([["ab", "ü"], ["", "漢字 x"], ["z", "y"]]), np.array([np.nan, -0.0, 1e300])]


@pytest.mark.parametrize("values", ARRAYS)
@pytest.mark.parametrize("kind", ["csn", "npy"])
def test_round_trip(spark, values, kind):
    path = str(folder() / f"a.{kind}")
    files.save(Tensor(fromarray(spark, values).df.repartition(5), values.ndim), path)
    back = files.load(spark, path)
    np.testing.assert_equal(cells(back), dict(np.ndenumerate(values)))
    assert not list(Path(path).parent.glob("*.draft"))
    if kind == "npy":
        np.testing.assert_array_equal(np.load(path), values)


def test_bytes_of_a_csn_file(spark):
    """As laid down: 64 bytes of header, then doubles or strings with their lengths."""
    path = folder() / "a.csn"
    files.save_csn(fromarray(spark, [[1.0, 2.0, 3.0]]), str(path))
    head = b"CSDN" + struct.pack("<HHIIQ8IQ", 1, 0, 1, 2, 3, 1, 3, 0, 0, 0, 0, 0, 0, 24)
    assert path.read_bytes() == head + struct.pack("<3d", 1, 2, 3) and len(head) == 64
    files.save_csn(fromarray(spark, ["é", "", "xyz"]), str(path))
    body = b"".join(struct.pack("<I", len(b)) + b for b in ("é".encode(), b"", b"xyz"))
    assert path.read_bytes() == csn_header(STRING, (3,), len(body)) + body


def test_one_file_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SPLIT_BYTES", 1000)
    monkeypatch.setattr(ranges, "BATCH_CELLS", 37)
    x = np.random.default_rng(1).normal(size=(40, 21))
    path = str(folder() / "a.csn")
    files.save(fromarray(spark, x), path)
    parts = ranges.RangeReader(path, [(path, csn_layout(open(path, "rb"), 64 + x.nbytes))]).partitions()
    assert len(parts) == 7 and [(p.start, p.stop) for p in parts[:2]] == [(0, 125), (125, 250)]
    assert [b["v"].to_pylist() for p in parts for b in [ranges.pa.Table.from_batches(ranges.RangeReader(path, []).read(p))]] == [x.ravel()[p.start : p.stop].tolist() for p in parts]


@pytest.mark.parametrize("segment", [2, 3, 1000])
def test_strings_by_segments_and_holes(spark, monkeypatch, segment):
    monkeypatch.setattr(files, "SEGMENT_CELLS", segment)
    rows = [(i, f"word{'ß' * i}") for i in range(11) if i not in (2, 3, 7)]
    path = str(folder() / "a.csn")
    files.save_csn(Tensor(spark.createDataFrame(rows, "i0 long, v string").repartition(3), 1), path)
    assert cells(files.load(spark, path)) == {(i,): dict(rows).get(i, "") for i in range(11)}
    numbers = Tensor(spark.createDataFrame([(0, 1.0), (4, 2.0)], "i0 long, v double"), 1)
    files.save_csn(numbers, path)
    assert cells(files.load(spark, path)) == {(i,): {0: 1.0, 4: 2.0}.get(i, 0.0) for i in range(5)}


GOOD = csn_header(REAL, (2, 3), 48) + bytes(48)


@pytest.mark.parametrize(
    ("content", "says"),
    [
        (b"", "signature"),
        (b"CSDX" + GOOD[4:], "signature"),
        (GOOD[:40], "signature"),
        (GOOD[:4] + b"\2" + GOOD[5:], "version"),
        (GOOD[:6] + b"\1" + GOOD[7:], "version"),
        (GOOD[:8] + b"\7" + GOOD[9:], "element type"),
        (GOOD[:12] + b"\x09" + GOOD[13:], "rank"),
        (GOOD[:16] + b"\5" + GOOD[17:], "cells of shape"),
        (GOOD[:24] + b"\5" + GOOD[25:], "cells of shape"),
        (GOOD[:56] + b"\1" + GOOD[57:], "payload"),
        (GOOD[:-1], "payload"),
        (GOOD + b"x", "payload"),
        (csn_header(STRING, (2,), 12) + struct.pack("<I", 9) + b"abcdefgh", "early"),
        (csn_header(STRING, (2,), 12) + struct.pack("<I", 1) + b"a" + struct.pack("<I", 0) + b"xyz", "strings end"),
    ],
)
def test_damaged_files_raise(spark, content, says):
    path = folder() / "a.csn"
    path.write_bytes(content)
    with pytest.raises(Exception, match=says):
        files.load(spark, str(path)).df.collect()


def test_folders_and_numpy_types(spark):
    at = folder()
    x = np.arange(12).reshape(3, 4)
    for k, a in enumerate([x.astype(">i4"), x.astype("<f4"), np.asfortranarray(x.astype(float)), x.astype("u1")]):
        np.save(at / f"{k}.npy", a)
    files.save_csn(fromarray(spark, x.astype(float)), str(at / "4.csn"))
    found = files.load_arrays(spark, f"file://{at}")
    assert found.ndim == 2 and found.df.count() == 60
    assert found.df.groupBy("path").agg({"v": "sum"}).collect() and all(r.v == 4 * r.i0 + r.i1 for r in found.df.collect())
    np.save(at / "5.npy", np.arange(3.0))
    with pytest.raises(Exception, match="several ranks"):
        files.load_arrays(spark, str(at))
    other = folder()
    np.save(other / "s.npy", np.array([b"ab", b"c"]))
    assert cells(Tensor(files.load_arrays(spark, str(other)).df.drop("path"), 1)) == {(0,): "ab", (1,): "c"}
    with pytest.raises(Exception, match="no array files"):
        files.load_arrays(spark, str(folder())).df.collect()


def wav(kind, bits, x):
    form = struct.pack("<HHIIHH", kind, 2, 8000, 8000 * 2 * bits // 8, 2 * bits // 8, bits)
    body = b"LIST" + struct.pack("<I", 3) + b"odd\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(x)) + x
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_samples_by_ranges(spark, bits, monkeypatch):
    monkeypatch.setattr(ranges, "BATCH_CELLS", 5)
    n = np.array([0, 1, -1, 2 ** (bits - 1) - 1, -(2 ** (bits - 1)), 5, -7, 3])
    raw = b"".join((int(v) + 128).to_bytes(1, "little") if bits == 8 else int(v).to_bytes(bits // 8, "little", signed=True) for v in n)
    at = folder()
    (at / "a.wav").write_bytes(wav(1, bits, raw))
    want = {(c, f): n[2 * f + c] / 2 ** (bits - 1) for c in range(2) for f in range(4)}
    assert cells(Tensor(files.load_arrays(spark, str(at)).df.drop("path"), 2)) == want
    samples, rate = files.parse_wav((at / "a.wav").read_bytes())
    assert dict(np.ndenumerate(samples)) == want and rate == 8000


def test_audio_of_one_and_two_channels(spark):
    at = folder()
    x = np.array([[0.5, -1.0, 0.25], [1.0, 0.0, -0.125]])
    files.save_audio(fromarray(spark, x), str(at / "a.wav"), 44100)
    assert (at / "a.wav").read_bytes() == files.wav_bytes(x, 44100)
    files.save_audio(fromarray(spark, x[0]), str(at / "b.wav"), 8000)
    assert (at / "b.wav").read_bytes() == files.wav_bytes(x[0], 8000)
    with pytest.raises(ValueError, match="isn't|key"):
        files.save_audio(Tensor(spark.createDataFrame([("k", 0, 1.0)], "k string, i0 long, v double"), 1, ("k",)), str(at / "c.wav"), 1)


def test_failed_tasks_leave_no_file(spark):
    at = folder()
    bad = Tensor(spark.range(10).selectExpr("id AS i0", "CASE WHEN id = 7 THEN double(raise_error('no')) ELSE 1D END AS v"), 1, (), (10,))
    with pytest.raises(Exception, match="no"):
        files.save_csn(bad, str(at / "a.csn"))
    assert not list(at.iterdir())


def test_types_of_numpy_headers():
    out = io.BytesIO()
    np.save(out, np.zeros(2, [("a", "f8")]))
    with pytest.raises(ValueError, match="type"):
        from latticeframe.sources.layouts import npy_layout

        out.seek(0)
        npy_layout(out, len(out.getvalue()))
