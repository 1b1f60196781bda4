"""Packing documents into sequences by a swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BYTE_PATTERN, KEPT_LENGTH, WHITE_SPACE, Encoder
from .shared import bounded, values, written

#: Stretches between spaces that a Python worker keeps with their ids, some 100 MB; when full, the cache is emptied.
CACHE_UNITS = 500_000
#: Pieces that one task packs together.
GROUP_PIECES = 8192
#: A round that leaves more than this share of its pieces in bins that aren't full is the last.
LAST_SHARE = 0.9


class FastEncoder(dict):
    """Ids of text by a byte-level vocabulary file, little-endian 32-bit; stretches between spaces are kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        spec = Encoder(path)
        ids = list(x & 0xFFFFFFFF for x in spec.merges.values())
        if spec.suffix or ids != sorted(ids):
            raise ValueError(f"{path} is not a byte-level vocabulary in the order of its merges")
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in spec.special.items()}
        self.special_pattern = spec.special_pattern
        ranks = {bytes(spec.bytes_of[c] for c in t): i for t, i in spec.vocab.items()}
        self.own = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, unit: str) -> bytes:
        ids = self.own.encode_ordinary(unit)
        out = pack(f"<{len(ids)}I", *ids)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = out
        return out

    def _plain(self, text: str) -> bytes:
        if any(c + " " in text for c in WHITE_SPACE):  # a run of white space may be one piece
            return np.array(self.own.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + x for x in rest]))

    def encode(self, text: str) -> bytes:
        if not self.special or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut where longer than ``capacity``.

    Of a document that is cut only the first piece may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = fast_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for at, text in enumerate(values(batch.column(1))):
                ids = code.encode(text or "") + end
                n = len(ids) // 4
                start, stop = 0, n - (n - 1) // capacity * capacity
                piece = 0
                while start < n:
                    part = ids[4 * start : 4 * stop]
                    for c, x in zip(rows, (at, piece, start, stop - start, zlib.crc32(part), part if keep_ids else None), strict=True):
                        c.append(x)
                    start, stop, piece = stop, stop + capacity, piece + 1
            arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(rows[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        bounded(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    )


class Bins:
    """Bins of one group under local search. Items are sizes; a bin's worth is its squared fill."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.sizes = sizes.tolist()
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self._best_fit()
        #: Of each size, the items in bins that aren't full.
        self.open: dict[int, set[int]] = defaultdict(set)
        self.count = np.zeros(capacity + 1, np.int64)
        self.bin_of = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                self.bin_of[i] = b
                if self.fill[b] < capacity:
                    self._offer(i)

    def _best_fit(self) -> None:
        rooms: list[tuple[int, int]] = []  # (room, bin), ascending
        for i in sorted(range(len(self.sizes)), key=self.sizes.__getitem__, reverse=True):
            size = self.sizes[i]
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
                self.bins[b].append(i)
                self.fill[b] += size
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(size)
            if room > size:
                insort(rooms, (room - size, b))

    def _offer(self, i: int) -> None:
        self.open[self.sizes[i]].add(i)
        self.count[self.sizes[i]] += 1

    def _withdraw(self, i: int) -> None:
        self.open[self.sizes[i]].discard(i)
        self.count[self.sizes[i]] -= 1

    def _elsewhere(self, size: int, b: int, but: int = -1) -> int | None:
        """An item of that size in another, less filled bin."""
        for i in self.open.get(size, ()):
            if i != but and self.bin_of[i] != b and self.fill[self.bin_of[i]] <= self.fill[b]:
                return i
        return None

    def _exchange(self, b: int, out: list[int], into: list[int]) -> bool:
        """Trades items if that raises the sum of squared fills and every bin still holds its items."""
        change: dict[int, int] = defaultdict(int)
        for i in into:
            change[self.bin_of[i]] -= self.sizes[i]
            change[b] += self.sizes[i]
        home = self.bin_of[into[0]]
        for i in out:
            change[home] += self.sizes[i]
            change[b] -= self.sizes[i]
        if any(self.fill[x] + d > self.capacity for x, d in change.items()):
            return False
        if sum((self.fill[x] + d) ** 2 - self.fill[x] ** 2 for x, d in change.items()) <= 0:
            return False
        for i in into:
            self.bins[self.bin_of[i]].remove(i)
            self.bins[b].append(i)
            self.bin_of[i] = b
        for i in out:
            self.bins[b].remove(i)
            self.bins[home].append(i)
            self.bin_of[i] = home
        for x, d in change.items():
            self.fill[x] += d
            if self.fill[x] == self.capacity:
                for i in self.bins[x]:
                    self._withdraw(i)
        return True

    def _improve(self, b: int, exact: bool) -> bool:
        room = self.capacity - self.fill[b]
        items = self.bins[b]
        # first what fills the bin: move one in, one for one, two for one, one for two
        for out in ([], *([i] for i in items)):
            want = room + sum(self.sizes[i] for i in out)
            if want <= self.capacity and (j := self._elsewhere(want, b)) is not None and self._exchange(b, out, [j]):
                return True
        for out in ([], *([i] for i in items)):
            want = room + sum(self.sizes[i] for i in out)
            y = np.flatnonzero(self.count[1 : want // 2 + 1] * self.count[want - 1 : want - want // 2 - 1 : -1]) + 1 if want > 1 else []
            for size in np.asarray(y).tolist():
                first = self._elsewhere(size, b)
                second = None if first is None else self._elsewhere(want - size, b, first)
                if second is not None and self._exchange(b, out, [first, second]):
                    return True
        for k, i in enumerate(items):
            for j in items[:k]:
                want = room + self.sizes[i] + self.sizes[j]
                if want <= self.capacity and (x := self._elsewhere(want, b)) is not None and self._exchange(b, [i, j], [x]):
                    return True
        if exact:
            return False
        # else the largest item that fits, alone or for one of these
        for out in ([], *([i] for i in items)):
            most = room + sum(self.sizes[i] for i in out)
            low = sum(self.sizes[i] for i in out) + 1
            for size in (np.flatnonzero(self.count[low : most + 1])[::-1] + low).tolist():
                if (j := self._elsewhere(size, b)) is not None and self._exchange(b, out, [j]):
                    return True
        return False

    def search(self, exact: bool) -> None:
        """Exchanges until nothing improves; each raises the sum of squares, so this ends."""
        improved = True
        while improved:
            improved = False
            for b in sorted(range(len(self.bins)), key=self.fill.__getitem__, reverse=True):
                while 0 < self.fill[b] < self.capacity and self._improve(b, exact):
                    improved = True


def _packer(capacity: int, level: int, last: bool):
    """The packing of one group of pieces (uid, length, g)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins = Bins(frame["length"].to_numpy(), capacity)
        bins.search(exact=True)
        if last:
            bins.search(exact=False)
        order = [i for b in bins.bins for i in b]
        number = np.repeat(np.arange(len(bins.bins)), [len(b) for b in bins.bins])
        length = frame["length"].to_numpy()[order]
        ends = np.cumsum(length)
        starts = ends - length
        first = np.zeros(len(order), bool)
        if len(order):
            first[0] = True
            first[1:] = number[1:] != number[:-1]
        base = np.maximum.accumulate(np.where(first, starts, 0))
        full = np.array(bins.fill, np.int64)[number] == capacity if len(order) else np.zeros(0, bool)
        seq = (level << 50) + (int(frame["g"].iloc[0]) << 16) + number
        return pd.DataFrame({"uid": frame["uid"].to_numpy()[order], "length": length, "sequence_id": seq, "offset": starts - base, "done": full | last})

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Packs the tokens of all documents into as few sequences of at most ``capacity`` as the search finds.

    Takes ``doc_id`` and ``text`` (null: empty) and ignores other columns. Only documents longer
    than ``capacity`` are cut. Returns for each piece doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids with ``keep_ids``). Full pieces are sequences of their own. The
    others are dealt at random into groups of some 8192; each task packs its group by best fit,
    then by exchanges between underfull bins that fill one of them. Bins that are full are done;
    the pieces of the others are dealt anew, round after round, until one group is left or a round
    settles less than a tenth. In that last round all groups go on with exchanges that raise the
    sum of squared fills until none is left, and their bins stay. Repeated rows and null ids are
    packed like any other; an empty table gives an empty table.
    """
    # numbers are written with their pieces: read again by other executors, a table may be split otherwise
    pieces = written(tokenized_pieces(docs, tokenizer, capacity, end_id, keep_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    names = [c for c in pieces.columns if c != "uid"]
    whole = pieces.filter(F.col("length") == capacity).select(*names, (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = None
    left = pieces.filter(F.col("length") < capacity).select("uid", "length")
    n = left.count()
    level = 0
    while n:
        groups = -(-n // GROUP_PIECES)
        dealt = left.withColumn("g", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))

        def packed(last: bool, dealt: DataFrame = dealt, level: int = level) -> DataFrame:
            return written(dealt.groupBy("g").applyInPandas(_packer(capacity, level, last), "uid long, length long, sequence_id long, offset long, done boolean"), "packed")

        result = packed(groups == 1)
        waiting = result.filter("NOT done").count()
        if groups > 1 and waiting > LAST_SHARE * n:
            result, waiting = packed(True), 0
        mine = result.filter("done").select("uid", "sequence_id", "offset")
        placed = mine if placed is None else placed.union(mine)
        left, n, level = result.filter("NOT done").select("uid", "length"), waiting, level + 1
    if placed is None:
        return whole
    return whole.union(pieces.filter(F.col("length") < capacity).join(placed, "uid").select(*names, "sequence_id", "offset"))
