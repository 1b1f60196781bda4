"""Samples (key, i, ts, v) as streams: frames, overlap-add, filters with state, cursors and accumulators.

``i`` is a signal's sample number, gapless from 0. Signals are independent, so state is kept for
each key; samples that arrive early wait in the state until those before them are there. Without a time,
a sample that never comes keeps all later ones of its signal waiting. With one, see ``patient``, it is
given up after a while and counts as 0, so state stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import filters

SAMPLES = "key string, i long, v double"
#: Samples that a step takes at once, so that what it makes is bounded however large a batch is.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Patience:
    """How long later samples wait for a missing one: event time by which the watermark must have passed theirs."""

    column: str
    millis: int


def patient(samples: DataFrame, time: str, delay: str, millis: int) -> DataFrame:
    """Samples with a column of event time, whose watermark is ``delay`` behind, for operators that give missing ones up after ``millis``.

    Every operator of this module that keeps state takes them. Samples whose time isn't beyond the watermark, or whose numbers
    have passed, are ignored.
    """
    out = samples.withWatermark(time, delay)
    out._patience = Patience(time, millis)
    return out


#: A sample that waits: its number, value and event time. Numbers of one map entry, of which a batch writes those that change.
HELD, HELD_NUMBERS = np.dtype([("i", "<i8"), ("v", "<f8"), ("at", "<i8")]), 1 << 12


class InLine(StatefulProcessor):
    """Hands samples on in order. Early ones wait in a map, an entry for each stretch of ``HELD_NUMBERS`` numbers, so a batch writes only stretches that change.

    The earliest sample that waits has a timer. When it expires, the samples missing before it count as 0.
    """

    def __init__(self, step: Callable, start: tuple, state: str, columns: list[str], patience: Patience):
        self.step, self.start, self.state, self.columns, self.patience = step, start, state, columns, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch long", "samples binary")
        self.own = handle.getValueState("own", "next_i long" + (f", {self.state}" if self.state else ""))

    def _advance(self, key: tuple, fresh: list[np.ndarray], timers: TimerValues) -> Iterator[pd.DataFrame]:
        next_i, *own = tuple(self.own.get()) if self.own.exists() else (0, *self.start)
        own = tuple(list(x) if hasattr(x, "__len__") else x for x in own)
        held = {k[0]: bytes(v[0]) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        pool = np.concatenate([np.zeros(0, HELD), *(np.frombuffer(x, HELD) for x in held.values()), *fresh])
        pool = pool[_in_order(pool["i"], next_i)]
        timer = pool["at"] + self.patience.millis
        early = np.diff(pool["i"], prepend=next_i - 1) != 1  # samples before it are missing
        stays = np.flatnonzero(early & (timer > timers.getCurrentWatermarkInMs()))
        count = int(stays[0]) if len(stays) else len(pool)
        i, v, rest = pool["i"][:count], pool["v"][:count], pool[count:]
        end = int(i[-1]) + 1 if count else next_i
        for at in range(next_i, max(end, next_i + 1), CHUNK):
            ready = np.zeros(min(end - at, CHUNK))
            lo, hi = np.searchsorted(i, [at, at + len(ready)])
            ready[i[lo:hi] - at] = v[lo:hi]
            made, own = self.step(ready, own, at)
            made.insert(0, "key", key[0])
            yield made[["key", *self.columns]]
        self.own.update((end, *own))
        stretches = np.split(rest, np.flatnonzero(np.diff(rest["i"] // HELD_NUMBERS)) + 1) if len(rest) else []
        kept = {int(x["i"][0]) // HELD_NUMBERS: x.tobytes() for x in stretches}
        for k in held.keys() - kept.keys():
            self.waiting.removeKey((k,))
        for k, x in kept.items():
            if held.get(k) != x:
                self.waiting.updateValue((k,), (x,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(rest):
            self.handle.registerTimer(int(timer[count]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for frame in rows:
            part = np.empty(len(frame), HELD)
            part["i"], part["v"] = frame["i"].to_numpy(), frame["v"].to_numpy()
            part["at"] = frame["at"].to_numpy().astype("datetime64[ms]").astype(np.int64)
            fresh.append(part)
        yield from self._advance(key, fresh, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def close(self) -> None:
        pass


#: The state store that keeps entries of maps apart.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(samples: DataFrame, step: Callable, start: tuple, state: str, out: str, patience: Patience) -> DataFrame:
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    columns = [c.split()[0] for c in out.split(", ")]
    rows = samples.select(F.col("key").cast("string").alias("key"), "i", "v", F.col(patience.column).alias("at"))
    made = InLine(step, start, state, columns, patience)
    return rows.groupBy("key").transformWithStateInPandas(made, f"key string, {out}", "append", "eventtime")


def _in_order(i: np.ndarray, first: int) -> np.ndarray:
    """Places of the sample numbers from ``first`` on, ascending; of equal numbers the last."""
    order = np.argsort(i, kind="stable")
    i = i[order]
    kept = i >= first
    kept[:-1] &= i[1:] != i[:-1]
    return order[kept]


def _gapless(i: np.ndarray, first: int) -> int:
    """How many of the ascending numbers follow each other from ``first`` on."""
    astray = np.flatnonzero(i != first + np.arange(len(i)))
    return int(astray[0]) if len(astray) else len(i)


def _stateful(samples: DataFrame, step: Callable[[np.ndarray, tuple, int], tuple[pd.DataFrame, tuple]], start: tuple, state: str, out: str) -> DataFrame:
    """``step`` of the samples next in line and the state, in order, for each key."""
    if getattr(samples, "_patience", None):
        return _timed(samples, step, start, state, out, samples._patience)
    names = ["waiting_i", "waiting_v", "next_i"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        waiting_i, waiting_v, next_i, *own = held.get if held.exists else ([], [], 0, *start)
        parts = [(np.array(waiting_i, np.int64), np.array(waiting_v, float))]
        parts += [(frame["i"].to_numpy(np.int64), frame["v"].to_numpy(float)) for frame in frames]
        i, v = (np.concatenate(columns) for columns in zip(*parts, strict=True))
        order = _in_order(i, next_i)
        i, v = i[order], v[order]
        count = _gapless(i, next_i)
        own = tuple(own)
        for at in range(0, max(count, 1), CHUNK):
            made, own = step(v[at : min(at + CHUNK, count)], own, next_i + at)
            made.insert(0, "key", key[0])
            yield made
        held.update((i[count:].tolist(), v[count:].tolist(), next_i + count, *own))

    schema = ", ".join([f"{names[0]} array<long>", f"{names[1]} array<double>", f"{names[2]} long", *([state] if state else [])])
    return samples.select(F.col("key").cast("string").alias("key"), "i", "v").groupBy("key").applyInPandasWithState(run, f"key string, {out}", schema, "append", GroupStateTimeout.NoTimeout)


def _frames(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """The full frames of x in rows."""
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop] if len(x) >= length else np.empty((0, length))


def snap(samples: DataFrame, length: int, hop: int) -> DataFrame:
    """(key, frame, data): overlapping frames of each signal, as soon as they are full."""
    if not 0 < hop <= length:
        raise ValueError(f"hop {hop} of frames of {length}")

    def step(ready: np.ndarray, own: tuple, first: int) -> tuple[pd.DataFrame, tuple]:
        tail, frame = np.concatenate([np.array(own[0], float), ready]), own[1]
        found = _frames(tail, length, hop)
        made = pd.DataFrame({"frame": frame + np.arange(len(found)), "data": pd.Series(list(found), dtype=object)})
        return made, (tail[len(found) * hop :].tolist(), frame + len(found))

    return _stateful(samples, step, ([], 0), "tail array<double>, frame long", "frame long, data array<double>")


def overlap_add(frames: DataFrame, hop: int) -> DataFrame:
    """(key, i, v): the sum of frames (key, frame, data) laid ``hop`` apart; of a stream, with a watermark, in complete or update mode."""
    cells = frames.select("key", "frame", F.posexplode("data").alias("at", "x"))
    return cells.groupBy("key", (F.col("frame") * hop + F.col("at")).alias("i")).agg(F.sum("x").alias("v"))


def overlapped(samples: DataFrame, length: int, hop: int, f: Callable[[np.ndarray], np.ndarray] = lambda frame: frame) -> DataFrame:
    """(key, i, v): the sum of ``f`` of each signal's overlapping frames, in the stream: a sample comes out when no later frame holds it."""
    if not 0 < hop <= length:
        raise ValueError(f"hop {hop} of frames of {length}")

    def step(ready: np.ndarray, own: tuple, first: int) -> tuple[pd.DataFrame, tuple]:
        tail, frame = np.concatenate([np.array(own[0], float), ready]), own[2]
        found = _frames(tail, length, hop)
        done = len(found) * hop
        sums = np.zeros(done + length)
        sums[: len(own[1])] = own[1]
        for k, data in enumerate(found):
            sums[k * hop : k * hop + length] += f(data.copy())
        made = pd.DataFrame({"i": frame * hop + np.arange(done), "v": sums[:done]})
        return made, (tail[done:].tolist(), sums[done:].tolist(), frame + len(found))

    return _stateful(samples, step, ([], [], 0), "tail array<double>, sums array<double>, frame long", "i long, v double")


def blocks(samples: DataFrame, size: int) -> DataFrame:
    """(key, block, data): consecutive blocks of a signal, one for each control period."""
    return snap(samples, size, size).withColumnRenamed("frame", "block")


def unblock(frames: DataFrame, size: int) -> DataFrame:
    """Samples of consecutive blocks."""
    return frames.select("key", "block", F.posexplode("data").alias("at", "v")).select("key", (F.col("block") * size + F.col("at")).alias("i"), "v")


def pack(channels: DataFrame, names: list[str]) -> DataFrame:
    """One column for each channel to rows (channel, i, v)."""
    pairs = ", ".join(f"{k}, `{n}`" for k, n in enumerate(names))
    rest = [c for c in channels.columns if c not in names]
    return channels.select(*rest, F.expr(f"stack({len(names)}, {pairs}) AS (channel, v)"))


def unpack(rows: DataFrame, count: int) -> list[DataFrame]:
    """A signal for each channel."""
    return [rows.filter(F.col("channel") == k).drop("channel") for k in range(count)]


def sosfilter(samples: DataFrame, sos: np.ndarray) -> DataFrame:
    """Second-order sections whose state goes on from batch to batch, for each key."""
    sos = np.atleast_2d(sos)

    def step(ready: np.ndarray, own: tuple, first: int) -> tuple[pd.DataFrame, tuple]:
        y, z = filters.filtered_sos(sos, ready, np.array(own[0], float).reshape(len(sos), 2))
        return pd.DataFrame({"i": np.arange(first, first + len(y)), "v": np.asarray(y, float)}), (z.ravel().tolist(),)

    return _stateful(samples, step, ([0.0] * 2 * len(sos),), "z array<double>", "i long, v double")


def lfilter(samples: DataFrame, b, a) -> DataFrame:
    n = max(len(a), len(b)) - 1

    def step(ready: np.ndarray, own: tuple, first: int) -> tuple[pd.DataFrame, tuple]:
        y, z = filters.filtered(np.asarray(b, float), np.asarray(a, float), ready, np.array(own[0], float))
        return pd.DataFrame({"i": np.arange(first, first + len(y)), "v": np.asarray(y, float)}), (z.tolist(),)

    return _stateful(samples, step, ([0.0] * n,), "z array<double>", "i long, v double")


def rt(name: str, samples: DataFrame, n: int, band: str, cutoff, *args: float, rate: float) -> DataFrame:
    """A named design (butter, cheby1, cheby2 or ellip) run on the stream."""
    return sosfilter(samples, filters.design_sos(name, n, band, cutoff, *args, rate=rate))


def next_(samples: DataFrame) -> DataFrame:
    """(key, i, v): each signal's samples one after the other, in order, however they arrive."""
    step = lambda ready, own, first: (pd.DataFrame({"i": np.arange(first, first + len(ready)), "v": ready}), own)
    return _stateful(samples, step, (), "", "i long, v double")


def accumulate(samples: DataFrame) -> DataFrame:
    """(key, i, v): the running sum of each signal, kept from batch to batch."""

    def step(ready: np.ndarray, own: tuple, first: int) -> tuple[pd.DataFrame, tuple]:
        sums = own[0] + np.cumsum(ready)
        return pd.DataFrame({"i": np.arange(first, first + len(ready)), "v": sums}), (float(sums[-1]) if len(ready) else own[0],)

    return _stateful(samples, step, (0.0,), "total double", "i long, v double")


def triggered(stream: DataFrame, f: Callable[[DataFrame, int], None], trigger: Callable[[DataFrame], bool] = lambda batch: True):
    """Runs ``f`` of each micro-batch for which ``trigger`` holds; otherwise what was published before stays."""
    return stream.writeStream.foreachBatch(lambda batch, k: f(batch, k) if trigger(batch) else None)


def frozen(spark, name: str) -> DataFrame:
    """A stream's published table as it is now, as an ordinary DataFrame."""
    return spark.table(name)
