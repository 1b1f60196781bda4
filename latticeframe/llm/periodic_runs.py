"""Periodic runs of words: power-of-two names (Karp, Miller, Rosenberg) in NumPy, without hashes or suffix sorting."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, values

#: A run has so many words and so many periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Each key's name: its rank among the distinct ones; and how many there are."""
    order = np.argsort(keys)
    in_order = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[1:] = np.cumsum(in_order[1:] != in_order[:-1])
    rank[:1] = 0
    out = np.empty(len(keys), np.int32)
    out[order] = rank
    return out, int(rank[-1]) + 1


class Names:
    """Names of all stretches of 1, 2, 4, ... words: two stretches of a level are equal if their names are.

    Levels end before the first whose stretches all differ: beyond it no two are equal either. Takes
    4 bytes for each word and level.
    """

    def __init__(self, words: list[bytes]):
        known: dict[bytes, int] = {}
        self.n = len(words)
        level, count = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, self.n), len(known)
        self.levels = []
        while count < len(level):
            self.levels.append(level)
            half = 1 << len(self.levels) - 1
            if 2 * half >= self.n:
                break
            level, count = named(level[:-half].astype(np.int64) * count + level[half:])

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a and from b (beyond a) on are equal: by descending levels, each at most once."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names = self.levels[j]
            k = np.flatnonzero(b + out < len(names))
            k = k[names[a[k] + out[k]] == names[b[k] + out[k]]]
            out[k] += 1 << j
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a and before b (beyond a) are equal."""
        out = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[j], 1 << j
            k = np.flatnonzero(a - out >= size)
            k = k[names[a[k] - out[k] - size] == names[b[k] - out[k] - size]]
            out[k] += size
        return out


def _first_period(j: int) -> int:
    """The least period from which on every run has a whole aligned stretch of 2**j words that repeats one period on.

    In the shortest run of period q, max(24, 3 * q) - q words in a row (16 at least) equal those q further on.
    """
    stretch = (2 << j) - 1
    return 1 if stretch <= 16 else -(-stretch // (LEAST_PERIODS - 1))


def candidates(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """Places p on the grids of 2**j words, and periods q, such that the 2**j words from p and from p + q on are equal.

    A period belongs to the highest level that fits its shortest run. Of neighbouring places of a
    grid with the same period only the first is kept.
    """
    n, places, periods = names.n, [], []
    for j, level in enumerate(names.levels):
        low, high = _first_period(j), min(_first_period(j + 1), n // LEAST_PERIODS + 1)
        if _first_period(j + 1) == 1 or low >= high:
            continue
        grid = level[:: 1 << j]
        # past the end stand names that nothing has
        ahead = sliding_window_view(np.concatenate([level[low:], np.full(high, -1, level.dtype)]), high - low)[:: 1 << j]
        rows = min(len(grid), len(ahead))
        equal = grid[:rows, None] == ahead[:rows]
        equal[1:] &= ~equal[:-1].copy()
        p, q = np.nonzero(equal)
        places.append(p << j)
        periods.append(q + low)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs(words: list[bytes]) -> np.ndarray:
    """All runs as rows (start, length, period), by start, then period.

    A run is a stretch with smallest period q that has ``LEAST_WORDS`` words and ``LEAST_PERIODS`` * q
    words at least and that no neighbouring word extends with period q.
    """
    if len(words) < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    names = Names(words)
    p, q = candidates(names)
    before = names.backward(p, p + q)
    start, length = p - before, before + q + names.forward(p, p + q)
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    start, length, q = start[long], length[long], q[long]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    # stretches with three periods q and a smaller one, which then divides q, are the same for both: the smaller stays
    first = np.ones(len(q), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack([start, length, q], 1)[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, found[:, 0] + found[:, 2], 1)
    np.add.at(steps, found[:, 0] + found[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which a tenth of documents repeat a stretch to their end; a null id leaves them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def document_row(doc_id: int | None, text: bytes | None) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 and the collapsed words."""
    words = repeating((text or b"").split(), doc_id)  # bytes are split at the six ASCII spaces
    found = runs(words)
    best: tuple = (None, None, None, None)
    if len(found):
        # exact comparison of length / period: by cross products
        best = tuple(found[0].tolist())
        for start, length, q in found[1:].tolist():
            if length * best[2] > best[1] * q:
                best = start, length, q
        best = *best, 1000 * best[1] // best[2]
        words = [words[i] for i in np.flatnonzero(kept(len(words), found)).tolist()]
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found.tolist())
    collapsed = b" ".join(words)
    return len(found), *best, sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest(), collapsed


COLUMNS = (("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string"), ("collapsed", "string"))
KINDS = {"long": pa.int64(), "string": pa.string()}


def periodic_runs(docs: DataFrame, keep: bool = True) -> DataFrame:
    """Finds the runs of every text and the text without their repeats.

    Takes ``doc_id`` and ``text`` (null: no words) and ignores other columns, whatever their names.
    Returns for each row doc_id, n_runs, the run with the greatest length / period (start, length,
    period, exponent_milli; ties: the smallest start, then period; nulls without runs), runs_sha256,
    collapsed_sha256 and, with ``keep``, the collapsed text. Texts are whole, of any length (memory: 4
    bytes for each word and level of names); the work is row by row without a shuffle, so repeated
    rows and null ids (nothing is made to repeat in them) come back as they are and an empty table
    gives an empty table.
    """
    columns = COLUMNS if keep else COLUMNS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [document_row(i, t)[: len(columns)] for i, t in zip(values(batch.column(0)), values(batch.column(1)), strict=True)]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns]
            arrays = [pa.array(list(c), KINDS[kind]) for c, (_, kind) in zip(made, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(name for name, _ in columns)])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return taken.mapInArrow(bounded(run), "doc_id long, " + ", ".join(f"{name} {kind}" for name, kind in columns))
