"""Streams that lose samples: what waits is given up by event time; frames overlap and add within the stream."""

import datetime
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from latticeframe.streaming import signals
from pyspark.sql import functions as F

START = datetime.datetime(2024, 1, 1)


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def run(spark, f, batches, timed):
    """Feeds batches of (key, i, second, v), one after the other, and returns all that comes out."""
    at = folder()
    for k, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["key", "i", "second", "v"]).astype({"i": "int64", "second": "int64", "v": float})
        frame.to_parquet(at / f"{k}.parquet")
        (at / f"{k}.parquet").touch()
    stream = spark.readStream.schema("key string, i long, second long, v double").option("maxFilesPerTrigger", 1).parquet(str(at))
    stream = stream.withColumn("ts", (F.lit(START) + F.make_interval(secs=F.col("second"))).cast("timestamp"))
    if timed:
        stream = signals.patient(stream, "ts", "0 seconds", 5000)
    out, name = f(stream), f"p{abs(hash(str(at)))}"
    out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder())).trigger(availableNow=True).start().awaitTermination(180)
    return signals.frozen(spark, name).toPandas()


def test_a_lost_sample_is_given_up(spark):
    """Sample 3 of a never comes, that of b comes late but in time; sample 1 of c comes after it was given up."""
    batches = [
        [("a", i, i, 10.0 + i) for i in (0, 1, 2, 4, 5)] + [("b", i, i, 20.0 + i) for i in (0, 1, 2, 4)] + [("c", i, i, 1.0) for i in (0, 2)],
        [("b", 3, 6, 23.0), ("a", 6, 6, 16.0)],
        [("a", 7, 30, 17.0), ("b", 5, 30, 25.0), ("c", 3, 30, 2.0)],
        [("a", 8, 31, 18.0)],
        [("a", 9, 60, 19.0), ("c", 1, 60, 9.0)],
    ]
    got = run(spark, signals.next_, batches, True)
    out = {k: g.sort_values("i").v.tolist() for k, g in got.groupby("key")}
    assert out["a"] == [10, 11, 12, 0, 14, 15, 16, 17, 18, 19]
    assert out["b"] == [20, 21, 22, 23, 24, 25]
    assert out["c"] == [1, 0, 1, 2]


def test_frames_go_on_after_a_loss(spark):
    batches = [[("a", i, i, 1.0 + i) for i in range(12) if i != 5], [("a", 12, 40, 13.0)], [("a", 13, 80, 14.0)], [("a", 14, 120, 15.0), ("a", 15, 120, 16.0)]]
    got = run(spark, lambda s: signals.snap(s, 4, 4), batches, True).sort_values("frame")
    assert got.frame.tolist() == [0, 1, 2, 3]
    assert [list(d) for d in got["data"]] == [[1, 2, 3, 4], [5, 0, 7, 8], [9, 10, 11, 12], [13, 14, 15, 16]]


@pytest.mark.parametrize("timed", [False, True])
def test_frames_overlap_within_the_stream(spark, timed):
    rng = np.random.default_rng(1)
    x = rng.normal(size=50)
    order = rng.permutation(50)
    batches = [[("a", int(i), k, x[i]) for i in order[k::3]] for k in range(3)]
    window = np.hanning(8)
    got = run(spark, lambda s: signals.overlapped(s, 8, 4, lambda frame: frame * window), batches, timed).sort_values("i")
    frames = (50 - 8) // 4 + 1
    want = np.zeros(50)
    for k in range(frames):
        want[4 * k : 4 * k + 8] += x[4 * k : 4 * k + 8] * window
    assert got.i.tolist() == list(range(4 * frames))
    np.testing.assert_allclose(got.v, want[: 4 * frames], atol=1e-12)
    with pytest.raises(ValueError, match="hop"):
        signals.overlapped(None, 4, 5)


def test_states_and_filters(spark):
    """The same as without a time, when nothing is lost."""
    batches = [[("a", i, i, float(np.sin(i))) for i in (1, 0, 3)], [("a", i, i, float(np.sin(i))) for i in (2, 5, 4)]]
    x = np.sin(np.arange(6))
    sums = run(spark, signals.accumulate, batches, True).sort_values("i")
    np.testing.assert_allclose(sums.v, np.cumsum(x), atol=1e-12)
    got = run(spark, lambda s: signals.lfilter(s, [0.5, 0.25], [1.0, -0.4]), batches, True).sort_values("i")
    y, last = [], (0.0, 0.0)
    for v in x:
        last = (0.5 * v + 0.25 * last[1] + 0.4 * last[0], v)
        y.append(last[0])
    np.testing.assert_allclose(got.v, y, atol=1e-12)
