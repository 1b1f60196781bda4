"""Streams whose batches are large: work grows with the samples, state with the stretches that wait."""

import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from latticeframe.streaming import signals

FRAMED = {
    "snap": lambda: signals.snap(None, 16, 8),
    "stream": lambda: signals.snap(None, 16, 8),
    "fromaudio": lambda: signals.blocks(None, 4),
    "toaudio": lambda: signals.blocks(None, 4),
    "overlapped": lambda: signals.overlapped(None, 16, 8, lambda frame: frame * 0.5),
}


def step_of(monkeypatch, make):
    """An operator's step and the state that it begins with."""
    found = {}

    def kept(samples, step, start, *rest):
        found.update(step=step, start=start)
        return SimpleNamespace(withColumnRenamed=lambda *names: None)

    monkeypatch.setattr(signals, "_stateful", kept)
    make()
    return found["step"], found["start"]


@pytest.mark.parametrize("name", FRAMED)
def test_a_large_batch_of_frames(monkeypatch, name):
    """A step that copies all that is left for each frame takes minutes here."""
    step, own = step_of(monkeypatch, FRAMED[name])
    x = np.random.default_rng(3).normal(size=500_000)
    begun = time.process_time()
    whole, _ = step(x, own, 0)
    assert time.process_time() - begun < 10
    parts = []
    for at in range(0, len(x), 99_991):
        made, own = step(x[at : at + 99_991], own, at)
        parts.append(made)
    cut = pd.concat(parts, ignore_index=True)
    for column in whole:
        a, b = (np.stack(f[column].to_numpy()) for f in (whole, cut))
        np.testing.assert_array_equal(a, b)


class Held(dict):
    """State of a key, which counts what is written."""

    writes = 0

    def exists(self):
        return bool(self)

    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]

    def get(self, *key):
        return super().get(*key) if key else self[0]

    def update(self, value):
        self[0] = value


def fed(made, batches):
    """What comes out of batches of (i, v, milliseconds), with the watermark before each; an expired timer runs after a batch."""
    waiting, own, timers, out = Held(), Held(), [], []
    made.init(SimpleNamespace(getMapState=lambda *a: waiting, getValueState=lambda *a: own, listTimers=lambda: list(timers), deleteTimer=timers.remove, registerTimer=timers.append))
    for now, rows in batches:
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now)
        frame = pd.DataFrame(rows, columns=["i", "v", "at"]).astype({"i": "int64", "v": float})
        frame["at"] = pd.to_datetime(frame["at"], unit="ms")
        if len(frame):
            out += list(made.handleInputRows(("a",), iter([frame]), at))
        if timers and min(timers) <= now:
            out += list(made.handleExpiredTimer(("a",), at, None))
    return pd.concat(out, ignore_index=True), waiting


def test_stream_loss_waits_by_stretches(monkeypatch):
    """Numbers 5, 42, ... never come: what waits is written by stretches, not one by one, and given up all at once."""
    monkeypatch.setattr(signals, "CHUNK", 1000, raising=False)
    step, start = step_of(monkeypatch, lambda: signals.accumulate(None))
    n = 40_000
    x = np.random.default_rng(4).normal(size=n)
    there = np.arange(n) % 37 != 5
    rows = [(i, x[i], i) for i in np.flatnonzero(there).tolist()]
    np.random.default_rng(5).shuffle(rows)
    made = signals.InLine(step, start, "total double", ["i", "v"], signals.Patience("ts", 0))
    begun = time.process_time()
    out, waiting = fed(made, [(0, rows), (n, []), (n, [(n, 1.0, n)])])
    assert time.process_time() - begun < 10
    assert not waiting and waiting.writes < 20
    assert out.i.tolist() == list(range(n + 1))
    np.testing.assert_allclose(out.v, np.cumsum([*np.where(there, x, 0), 1.0]), atol=1e-9)


def test_what_comes_late_twice_or_too_early(monkeypatch):
    """The last of equal numbers counts, passed numbers are ignored, and a gap holds only what comes after it."""
    step, start = step_of(monkeypatch, lambda: signals.next_(None))
    made = signals.InLine(step, start, "", ["i", "v"], signals.Patience("ts", 10))
    out, waiting = fed(made, [(0, [(0, 1.0, 0), (2, 2.0, 0), (2, 3.0, 0), (9000, 9.0, 5)]), (3, [(1, 4.0, 3), (0, 7.0, 3), (9000, 8.0, 5)]), (14, []), (15, [])])
    assert out.v[:3].tolist() == [1.0, 4.0, 3.0] and out.i.tolist() == list(range(9001))
    assert out.v[3:9000].eq(0).all() and out.v[9000] == 8.0 and not waiting
