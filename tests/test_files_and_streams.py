import io
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from latticeframe.operators import filters
from latticeframe.operators.creation import fromarray, toarray
from latticeframe.sources import files
from latticeframe.streaming import signals


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


@pytest.mark.parametrize("values", [np.arange(6.0).reshape(2, 3), np.array([[1 + 2j, 3 - 4j]]), np.array([["ab", "ü"]])])
def test_npy_round_trip(spark, values):
    at = folder()
    t = fromarray(spark, values)
    (at / "a.npy").write_bytes(files.npy_bytes(t))
    back = files.load_npy(spark, str(at), 2, t.kind)
    rows = {(r.i0, r.i1): complex(r.v.re, r.v.im) if t.kind == 1 else r.v for r in back.df.collect()}
    assert rows == {k: v for k, v in np.ndenumerate(values)}


def test_npy_types(spark):
    for dtype in ("<f4", ">i2", "|u1", "<f8"):
        out = io.BytesIO()
        np.save(out, np.array([1, 2, 3], dtype))
        assert files.parse_npy(out.getvalue()).tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        out = io.BytesIO()
        np.save(out, np.array([object()]), allow_pickle=True)
        files.parse_npy(out.getvalue())


def test_audio_and_parquet(spark):
    at = folder()
    x = np.array([[0.0, 0.5, -1.0], [1.0, 0.25, 0.0]])
    (at / "a.wav").write_bytes(files.audio_bytes(fromarray(spark, x), 8000))
    t, rates = files.load_audio(spark, str(at))
    assert {(r.i0, r.i1): r.v for r in t.df.collect()} == dict(np.ndenumerate(x))
    assert rates.first().rate == 8000
    files.save(fromarray(spark, x), str(at / "saved"))
    np.testing.assert_array_equal(toarray(files.load(spark, str(at / "saved"))), x)


def run(spark, make, rows, batches=3):
    """Feeds rows of (key, i, v) to a stream in several files and returns what it publishes."""
    at = folder()
    for k in range(batches):
        pd.DataFrame(rows[k::batches], columns=["key", "i", "v"]).astype({"i": "int64", "v": float}).to_parquet(at / f"{k}.parquet")
    stream = spark.readStream.schema(signals.SAMPLES).option("maxFilesPerTrigger", 1).parquet(str(at))
    name = f"t{abs(hash(str(at)))}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return signals.frozen(spark, name).toPandas()


ROWS = [(key, i, float(np.sin(i) + (key == "b"))) for i in range(30) for key in "ab"]


def test_frames_come_as_they_fill(spark):
    got = run(spark, lambda s: signals.snap(s, 8, 4), ROWS)
    for key in "ab":
        x = [v for k, _, v in ROWS if k == key]
        own = got[got.key == key].sort_values("frame")
        assert own.frame.tolist() == list(range(6))
        for k, data in zip(own.frame, own["data"], strict=True):
            assert list(data) == x[4 * k : 4 * k + 8]
    added = signals.overlap_add(spark.createDataFrame([("a", 0, [1.0, 1.0]), ("a", 1, [1.0, 1.0])], "key string, frame long, data array<double>"), 1)
    assert sorted((r.i, r.v) for r in added.collect()) == [(0, 1.0), (1, 2.0), (2, 1.0)]


def test_filter_state_goes_on(spark):
    sos = filters.design_sos("butter", 2, "lowpass", 0.2, rate=1.0)
    got = run(spark, lambda s: signals.rt("butter", s, 2, "lowpass", 0.2, rate=1.0), ROWS)
    for key in "ab":
        x = np.array([v for k, _, v in ROWS if k == key])
        np.testing.assert_allclose(got[got.key == key].sort_values("i").v, filters.filtered_sos(sos, x)[0], atol=1e-12)


def test_samples_in_order_and_sums(spark):
    shuffled = [ROWS[k] for k in np.random.default_rng(2).permutation(len(ROWS))]
    got = run(spark, signals.next_, shuffled)
    assert got[got.key == "a"].i.tolist() == list(range(30))
    sums = run(spark, signals.accumulate, shuffled)
    x = np.array([v for k, _, v in ROWS if k == "b"])
    np.testing.assert_allclose(sums[sums.key == "b"].sort_values("i").v, x.cumsum(), atol=1e-12)


def test_channels(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "i long, left double, right double")
    rows = signals.pack(df, ["left", "right"])
    assert sorted((r.channel, r.i, r.v) for r in rows.collect()) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    assert [r.v for r in signals.unpack(rows, 2)[1].orderBy("i").collect()] == [2.0, 4.0]
    again = signals.unblock(spark.createDataFrame([("a", 1, [5.0, 6.0])], "key string, block long, data array<double>"), 2)
    assert sorted((r.i, r.v) for r in again.collect()) == [(2, 5.0), (3, 6.0)]
