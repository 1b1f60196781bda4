"""Scoring texts by a probabilistic suffix tree over words, with one over characters beneath it.

Of the lower tree the symbols are the UTF-8 bytes of words, the end of a word and the end of a text. A context of up to
``DEPTH`` symbols stays in the tree if it is seen ``LEAST_COUNT`` times and its next symbols differ enough
from those of the context without its first symbol; next-symbol distributions are smoothed with
the shorter context's. Each symbol is scored in the state of the longest suffix in the tree, and a
word's symbols together smooth the word's own count. Of the upper tree the symbols are words: up to ``WORD_DEPTH``
words before are a context by the same two conditions, smoothed with the context without its first word, at last with the root.

Contexts and words are counted over all training texts. No tree is on the driver: both stay in tables. The lower one
is built and asked in parts, one for each pair of last symbols; the upper one is joined to blocks of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded, written
from .shingles import mix, word_hashes

U64 = np.uint64
DEPTH = 5
#: Times that a context is seen at least.
LEAST_COUNT = 2
#: Words in a context of the upper tree at most.
WORD_DEPTH = 3
#: A context stays if its count times its divergence from the shorter one (nats) is above this, plus its number of next symbols.
LEAST_DIVERGENCE = 8.0
SYMBOLS = 64
WORD_END, TEXT_END, RARE = 0, 1, 63
_SPACE, _NEWLINE = 0x20, 0x0A
#: Bytes of text that are counted or scored at a time; a longer text is handled alone, whole.
CHUNK = 1 << 20
#: Bytes of text in a block, whose documents are counted and look up counts together.
BLOCK_BYTES = 4 << 20
#: Bytes of text whose counts a task adds up before it hands them on.
HELD_BYTES = 64 << 20
#: Rounds in which blocks are scored.
ROUNDS = 4
#: Shards of keys for each shuffle partition.
SHARDS = 2
#: Share of unseen words in the base score.
SMALL = 0.1


def _pieces(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte stream, and where each begins: DEPTH newlines, then words with a space after each, then a newline."""
    parts = []
    for t in texts:
        words = b" ".join(t.lower().split())
        parts.append(b"\n" * DEPTH + words + (b" \n" if words else b"\n"))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _scored(starts: np.ndarray, n: int) -> np.ndarray:
    """Whether places in a stream aren't the newlines before a text."""
    keep = np.ones(n, bool)
    keep[(starts[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return keep


def _totals(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts or summed weights."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    edge = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[edge], np.diff(edge, append=len(values)) if weights is None else np.add.reduceat(weights, edge)


class Sums:
    """Counts by key that arrive in parts; they are merged whenever new parts outgrow what is merged already."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.new = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.new += len(keys)
        if self.new > max(1 << 20, len(self.parts[0][0])):
            self.parts, self.new = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return _totals(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))


def _raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _windows(stream: np.ndarray) -> np.ndarray:
    """At each place of a stream the last DEPTH + 1 bytes as a number."""
    padded = np.concatenate((np.zeros(7, np.uint8), stream))
    return np.ndarray(len(stream), ">u8", padded, strides=(1,)).astype(U64) & U64(256 ** (DEPTH + 1) - 1)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(window boolean, key, n) over all rows of (text): words by hash, and windows of DEPTH + 1 bytes.

    The end of a text counts as the word with key 0. Tasks add up 64 MB of text before the shuffle. Of rows of
    (text, learned) those not learned count 0: they add no words, but their windows are listed.
    """
    marked = len(texts.columns) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = Sums(), Sums()
        held = ends = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for window, sums in ((False, words), (True, windows)):
                keys, n = sums.total()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), window)), pa.array(keys.view(np.int64)), pa.array(n)], ["window", "key", "n"])
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array([False]), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], ["window", "key", "n"])

        for batch in batches:
            texts = _raw(batch.column(0))
            learned = batch.column(1).to_pylist() if marked else [True] * len(texts)
            for once in (1, 0):
                mine = [t for t, x in zip(texts, learned, strict=True) if bool(x) == bool(once)]
                for a, b in _pieces(mine):
                    own = mine[a:b]
                    stream, starts = _stream(own)
                    keys, n = _totals(_windows(stream)[_scored(starts, len(stream))])
                    windows.add(keys, n * once)
                    held += len(stream)
                    if once:
                        words.add(*_totals(word_hashes(own)[0]))
                        ends += b - a
                    if held >= HELD_BYTES:
                        yield from emit()
                        words, windows, held, ends = Sums(), Sums(), 0, 0
        yield from emit()

    return texts.mapInArrow(bounded(run), "window boolean, key long, n long").groupBy("window", "key").agg(F.sum("n").alias("n"))


def grams(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 1, 2, ... words: places of the tokens (each text's words, then its end) that have one, the context's
    key, that of the context without its first word (0: the root), and that of the context with the token.

    A key is a hash whose first 6 bits are the last token's, its group.
    """
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.zeros(len(words) + len(sizes), U64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = words
    position = np.arange(len(tokens)) - np.repeat(ends - sizes, sizes + 1)
    before, shorter = tokens, np.zeros(len(tokens), U64)
    for k in range(1, WORD_DEPTH + 1):
        longer = np.zeros(len(tokens), U64)
        longer[1:] = tokens[1:] >> U64(58) << U64(58) | mix(mix(before[:-1]) + tokens[1:]) >> U64(6)
        place = np.flatnonzero(position >= k)
        yield place, before[place - 1], shorter[place - 1], longer[place]
        before, shorter = longer, before


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys by whose order shards follow one another: the low half first, as the high one begins with a group."""
    return keys << U64(32) | keys >> U64(32)


def _sharded(turned: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's turned keys, which are sorted, begin and end."""
    return np.searchsorted((turned >> U64(32)) * U64(shards) >> U64(32), np.arange(shards + 1, dtype=U64))


def _compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers, compressed: all their first bytes, then all second ones, and so on."""
    return _compressed(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _grown(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_plain(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_grown(x, kind) for x in column.to_pylist())])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, a place of each, and for each place its key's number."""
    order = np.argsort(keys)
    keys = keys[order]
    edge = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=edge[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(edge) - 1
    return keys[edge], order[edge], inverse


def _distinct_few(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_distinct``, of keys that repeat often: only distinct ones are sorted."""
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    inverse = rank[coded.indices.to_numpy()]
    place = np.empty(len(found), np.int64)
    place[inverse] = np.arange(len(keys))
    return found[order], place, inverse


def _set(keys: np.ndarray) -> np.ndarray:
    return _totals(keys)[0]


class Block:
    """The tokens of a block's texts, and how often the grams that end at them are in training.

    A gram is only asked for if its context is seen ``LEAST_COUNT`` times, which is known of the depth before: a context is a
    gram, too. Others follow no state. Grams without context, and those of one word, are all asked for.
    """

    def __init__(self, texts: list[bytes], learned: np.ndarray, depth: int = WORD_DEPTH) -> None:
        found = [word_hashes(texts[a:b]) for a, b in _pieces(texts)]
        self.hashes, self.sizes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
        self.stop = np.cumsum(self.sizes + 1)  # ends stand after each text's words
        self.is_word = np.ones(len(self.hashes) + len(texts), bool)
        self.is_word[self.stop - 1] = False
        self.learned = np.repeat(learned, self.sizes + 1)
        none = np.zeros(len(self.hashes), U64)
        self.levels = [(np.flatnonzero(self.is_word), none, none, self.hashes), *islice(grams(self.hashes, self.sizes), depth)]
        self.counts: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []

    def follows(self, depth: int) -> np.ndarray:
        """Whether each gram's context is seen often enough."""
        place = self.levels[depth][0]
        return self.counts[depth - 1][place - 1] >= LEAST_COUNT

    def _asked(self, depth: int) -> np.ndarray:
        return np.flatnonzero(self.follows(depth)) if depth > 1 else np.arange(len(self.levels[depth][0]))

    def asks(self, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Turned keys of distinct grams, their counts in the block's training texts, and how many more there are, all seen once."""
        at = self._asked(depth)
        place, _, _, event = self.levels[depth]
        learned = self.learned[place]
        keys, _, inverse = (_distinct if depth else _distinct_few)(_turned(event[at]))
        counts = np.bincount(inverse, learned[at], len(keys)).astype(np.uint32)
        return keys, counts, int(learned.sum() - learned[at].sum())

    def learn(self, depth: int, answer: np.ndarray) -> None:
        """Takes counts in the order of ``asks``, twice, plus 1 for a gram that is this block's to pass on."""
        at = self._asked(depth)
        place, _, _, event = self.levels[depth]
        _, first, inverse = (_distinct if depth else _distinct_few)(_turned(event[at]))
        full = np.zeros(len(self.is_word), np.int64)
        full[place[at]] = (answer >> 1)[inverse]
        self.counts.append(full)
        self.owned.append(at[first[(answer & 1 == 1) & (answer > 1)]])

    def contexts(self) -> np.ndarray:
        """Turned keys of all distinct contexts that are seen often enough."""
        return _set(np.concatenate([_turned(self.levels[d][1][self.follows(d)]) for d in range(1, WORD_DEPTH + 1)]))


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, learned, wanted, data): the texts of (doc_id, text, learned, wanted) some ``BLOCK_BYTES`` at a time, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            ids, texts, learned, wanted = zip(*rows, strict=True)
            sizes = np.array([len(texts), *map(len, texts)], np.int64).tobytes()
            data = _compressed(b"".join((sizes, *texts)))
            flags = [pa.array([np.array(x, bool).tobytes()], pa.binary()) for x in (learned, wanted)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *flags, pa.array([data], pa.binary())], ["block", "ids", "learned", "wanted", "data"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), _raw(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                rows.append(row)
                size += len(row[1])
                if size >= BLOCK_BYTES:
                    yield emit()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield emit()

    return docs.mapInArrow(bounded(run), "block long, ids array<long>, learned binary, wanted binary, data binary")


def _opened(own: pa.Table, seen: pa.Table | None = None, depth: int = WORD_DEPTH) -> tuple[list[bytes], Block, dict[int, np.ndarray]]:
    """A block's texts, its tokens with grams up to a depth and what the counts in ``seen`` say of them, and the other answers by kind."""
    texts = _unpacked(own.column("data")[0].as_py())
    block = Block(texts, np.frombuffer(own.column("learned")[0].as_py(), bool), depth)
    answers = {}
    if seen is not None and seen.num_rows:
        seen = seen.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kinds = seen.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            a, b = np.searchsorted(kinds, [kind, kind + 1])
            answers[kind] = _joined(seen.column("data").slice(a, b - a), np.float32 if kind == WINDOW else np.int64)
    for k in range(WORD_DEPTH + 1):
        if k in answers:
            block.learn(k, answers.pop(k))
    return texts, block, answers


#: Kinds of questions: grams by their depth, then these.
STATE, WINDOW = WORD_DEPTH + 1, WORD_DEPTH + 2
#: What is kept of contexts: by context (its turned key and that without its first word), and by context and group of tokens that follow.
_BY_CONTEXT = {"context": U64, "depth": np.int8, "shorter": U64, "n": np.int64, "kinds": np.int64, "groups": np.int64}
_BY_GROUP = {"group": np.uint8, "m": np.int64}
_PASSED = {"at": np.int64, "group": np.uint8, "m": np.int64, "kinds": np.int64, "named": U64, "shorter": U64}


def _binaries(*columns: str) -> str:
    return "".join(f", {c} binary" for c in columns)


def _rows(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(c, kinds[k]) for c, k in (x.split() for x in schema.split(", "))]))


_CONTEXT_ROWS = "shard int" + _binaries(*_BY_CONTEXT, *_BY_GROUP)
_ANSWERS = "block long, kind int, shard int, data binary"
_SENT = "kind int, shard int, block long, keys binary, counts binary, more long" + _binaries(*_PASSED)
_KEPT = _ANSWERS + ", once long, twice long" + _binaries(*_BY_CONTEXT, *_BY_GROUP)


def _question(kind: int, block: int, shards: int, keys: np.ndarray, counts: np.ndarray, more: int) -> list[dict]:
    edge = _sharded(keys, shards).tolist()
    return [{"kind": kind, "shard": s, "block": block, "keys": _shrunk(keys[a:b]), "counts": _shrunk(counts[a:b]), "more": more * (s == 0)} for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a or s == 0]


def _answers(rows: pa.Table) -> list[dict]:
    """The blocks' counts of a shard's grams, added up. In the first row is how many grams are seen once and twice."""
    keys, counts = _joined(rows.column("keys"), U64), _joined(rows.column("counts"), np.uint32)
    distinct, first, inverse = _distinct(keys)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    answer = 2 * total[inverse]
    answer[first] += 1
    edge = np.cumsum([0, *(int.from_bytes(x[:8], "little") // 8 for x in rows.column("keys").to_pylist())]).tolist()
    out = [{"block": b, "kind": k, "shard": s} for b, k, s in zip(*(rows.column(c).to_pylist() for c in ("block", "kind", "shard")), strict=True)]
    for x, a, b in zip(out, edge[:-1], edge[1:], strict=True):
        x |= {"data": _shrunk(answer[a:b]), "once": 0, "twice": 0}
    out[0] |= {"once": int((total == 1).sum()) + pc.sum(rows.column("more")).as_py(), "twice": int((total == 2).sum())}
    return out


def _added(context, group, m, kinds) -> tuple[np.ndarray, ...]:
    """Sums by context and group, in their order."""
    order = np.lexsort((group, context))
    context, group = context[order], group[order]
    edge = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (group[1:] != group[:-1])))[: len(order)])
    if not len(edge):
        return context, group, m, kinds
    return context[edge], group[edge], np.add.reduceat(m[order], edge), np.add.reduceat(kinds[order], edge)


def _passed(block: Block, number: int, shards: int, depth: int) -> list[dict]:
    """What follows the contexts of a depth that are seen often enough, by shard.

    Each gram is passed on by one block, added up there with others of its context and group; the block of the gram that is a context
    also passes on the one without its first word.
    """
    place, context, shorter, event = block.levels[depth]
    at = block.owned[depth]
    at = at[block.follows(depth)[at]]
    group = (event[at] >> U64(58)).astype(np.uint8)
    parts = _added(_turned(context[at]), group, block.counts[depth][place[at]], np.ones(len(at), np.int64))
    named = np.zeros(0, np.int64)
    if depth > 1:
        ends = block.levels[depth - 1][0][block.owned[depth - 1]]
        ends = ends[block.is_word[ends] & (block.counts[depth - 1][ends] >= LEAST_COUNT)]
        named = np.searchsorted(place, ends + 1)
    names = _turned(context[named])
    order = np.argsort(names)
    names, less = names[order], _turned(shorter[named])[order]
    keys = _set(parts[0])
    edges = [_sharded(x, shards).tolist() for x in (keys, parts[0], names)]
    rows = []
    for s in range(shards):
        (a, b), (c, d), (e, f) = (x[s : s + 2] for x in edges)
        if b > a or f > e:
            passed = (np.searchsorted(keys[a:b], parts[0][c:d]), *(x[c:d] for x in parts[1:]), names[e:f], less[e:f])
            rows.append({"kind": -depth, "shard": s, "block": number, "keys": _shrunk(keys[a:b])} | {x: _shrunk(y) for x, y in zip(_PASSED, passed, strict=True)})
    return rows


def _contexts(rows: pa.Table, depth: int) -> list[dict]:
    """A shard's contexts of a depth: how many tokens and different ones follow them, and how many by group."""
    context = np.concatenate([_grown(k, U64)[_grown(a, np.int64)] for k, a in zip(rows.column("keys").to_pylist(), rows.column("at").to_pylist(), strict=True)])
    group, m, kinds, names, less = (_joined(rows.column(c), k) for c, k in list(_PASSED.items())[1:])
    context, group, m, kinds = _added(context, group, m, kinds)
    if not len(context):
        return []
    edge = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    shorter = less[np.argsort(names)] if depth > 1 else np.zeros(len(edge), U64)
    columns = (context[edge], np.full(len(edge), depth, np.int8), shorter, np.add.reduceat(m, edge), np.add.reduceat(kinds, edge), np.diff(edge, append=len(context)), group, m)
    return [{"kind": -depth, "shard": rows.column("shard")[0].as_py()} | {c: _shrunk(x) for c, x in zip((*_BY_CONTEXT, *_BY_GROUP), columns, strict=True)}]


def gram_counts(blocks: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Counts of grams of all depths as answers for each block, and all shards' contexts.

    A depth's grams are asked for when those of the depth before are counted; with them goes what follows that depth's contexts.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = pa.Table.from_batches([batch.slice(i, 1)])
                block, number = _opened(own, depth=1)[1], own.column("block")[0].as_py()
                for depth in (0, 1):
                    yield from _rows(_question(depth, number, shards, *block.asks(depth)), _SENT).to_batches()

    def step(depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def send(own: pa.Table, seen: pa.Table) -> pa.Table:
            block, number = _opened(own, seen, min(depth, WORD_DEPTH))[1], own.column("block")[0].as_py()
            asks = _question(depth, number, shards, *block.asks(depth)) if depth <= WORD_DEPTH else []
            return _rows(asks + _passed(block, number, shards, depth - 1), _SENT)

        return send

    def add(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        return _rows(_answers(rows) if kind >= 0 else _contexts(rows, -kind), _KEPT)

    added = lambda sent: written(sent.groupBy("kind", "shard").applyInArrow(add, _KEPT), "grams")
    found = added(blocks.mapInArrow(bounded(begin), _SENT))
    for depth in range(2, WORD_DEPTH + 2):
        seen = found.filter("kind >= 0").select("block", "kind", "shard", "data")
        found = found.unionAll(added(blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(step(depth), _SENT)))
    return found.filter("kind >= 0").select("block", "kind", "shard", "data", "once", "twice"), found.filter("kind < 0").select("shard", *_BY_CONTEXT, *_BY_GROUP)


def _read(table: pa.Table) -> dict[str, np.ndarray]:
    """Contexts of all depths in ``table``, in the order of their keys."""
    x = {c: _joined(table.column(c), k) for c, k in (_BY_CONTEXT | _BY_GROUP).items()}
    return _picked(x, np.argsort(x["context"]))


def _picked(x: dict[str, np.ndarray], order: np.ndarray) -> dict[str, np.ndarray]:
    first, sizes = (np.cumsum(x["groups"]) - x["groups"])[order], x["groups"][order]
    inner = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return {c: x[c][order] for c in _BY_CONTEXT} | {c: x[c][inner] for c in _BY_GROUP}


def _discount(once: int, twice: int) -> float:
    """Ney's estimate of the absolute discount, from how many events were seen once and twice."""
    return min(max((once + 0.5) / (once + 2 * twice + 1), 0.02), 0.98)


def word_tree(words: DataFrame, contexts: DataFrame, shards: int) -> DataFrame:
    """(shard, keys, found): turned keys of the upper tree's states below the root, and how many different tokens follow them.

    ``words`` (word, c) are all words' counts. A context goes to the shard of the one without its first word to be tested. A state's suffixes are states.
    The divergence of 64 groups of tokens is a lower bound of that of tokens, and few counts don't make it large.
    """
    root = np.full(64, 0.5)
    for r in words.groupBy(F.shiftrightunsigned("word", 58).cast("int").alias("g")).agg(F.sum("c").alias("n")).collect():
        root[r.g] += r.n
    base = root / root.sum()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of many shards, so that rows sent don't grow with the square of the shards
            x = _read(pa.Table.from_batches([batch]))
            to = np.where(x["depth"] == 1, x["context"], x["shorter"])
            order = np.argsort(to)
            x = _picked(x, order)
            edge, ends = _sharded(to[order], shards).tolist(), np.cumsum([0, *x["groups"]])
            rows = []
            for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if b > a:
                    rows.append({"shard": s} | {c: _shrunk(x[c][a:b]) for c in _BY_CONTEXT} | {c: _shrunk(x[c][ends[a] : ends[b]]) for c in _BY_GROUP})
            yield from _rows(rows, _CONTEXT_ROWS).to_batches()

    def test(asked: pa.Table, known: pa.Table) -> pa.Table:
        x, upper = _read(asked), _read(known)
        if not len(x["context"]):
            return _rows([], "shard int, key long")
        at = np.searchsorted(upper["context"], x["shorter"]) if len(upper["context"]) else np.zeros(len(x["context"]), np.int64)
        at[x["depth"] == 1] = 0
        of = np.repeat(np.arange(len(at)), x["groups"])
        pairs = np.repeat(np.arange(len(upper["context"])), upper["groups"]) * 64 + upper["group"]
        deep = x["depth"][of] > 1
        share = base[x["group"]]
        share[deep] = upper["m"][np.searchsorted(pairs, at[of[deep]] * 64 + x["group"][deep])] / upper["n"][at[of[deep]]]
        terms = np.bincount(of, x["m"] * np.log(x["m"] / x["n"][of] / share), len(at))
        kept = terms > LEAST_DIVERGENCE + x["groups"]
        longest = kept & (x["depth"] > 2)
        keys = _set(np.concatenate((x["context"][kept], x["shorter"][kept & (x["depth"] > 1)], upper["shorter"][at[longest]])))
        edge = _sharded(keys, shards)
        return pa.table({"shard": np.repeat(np.arange(shards, dtype=np.int32), np.diff(edge)), "key": keys.view(np.int64)})

    def number(known: pa.Table, kept: pa.Table) -> pa.Table:
        states = _set(kept.column("key").to_numpy().view(U64))
        if not len(states):
            return _rows([], "shard int, keys binary, found binary")
        x = _read(known)
        kinds = x["kinds"][np.searchsorted(x["context"], states)]
        return _rows([{"shard": kept.column("shard")[0].as_py(), "keys": _shrunk(states), "found": _shrunk(kinds)}], "shard int, keys binary, found binary")

    kept = contexts.mapInArrow(bounded(send), _CONTEXT_ROWS).groupBy("shard").cogroup(contexts.groupBy("shard")).applyInArrow(test, "shard int, key long")
    return contexts.groupBy("shard").cogroup(kept.groupBy("shard")).applyInArrow(number, "shard int, keys binary, found binary")


class SuffixTree:
    """The tree as two tables by state and symbol: the state with one more symbol before, and log10 of the next one's probability.

    A state has a twin in which it stays, for when no longer context is in the tree.
    """

    def __init__(self, alphabet: np.ndarray, contexts: dict[int, np.ndarray], part: bool = False) -> None:
        """``alphabet``: the symbol of each byte; ``contexts``: counts of next symbols by context, symbols packed by 6 bits after a leading 1.

        In a part of the tree contexts of one symbol stay, as other parts may need them.
        """
        self.symbol = alphabet
        depth_of = {key: (key.bit_length() - 1) // 6 for key in contexts}
        root = contexts.get(1, np.zeros(SYMBOLS))
        shares = {1: (root + 0.5) / (root.sum() + 0.5 * SYMBOLS)}
        kept = {1, *(k for k in contexts if part and depth_of[k] == 1)}
        for key in sorted((k for k in contexts if k != 1), key=lambda k: (depth_of[k], k)):
            shorter = self._shorter(key, depth_of[key])
            if shorter not in shares:
                continue
            counts, before = contexts[key], shares[shorter]
            total, seen = counts.sum(), counts > 0
            shares[key] = (counts + seen.sum() * before) / (total + seen.sum())
            if (counts[seen] * np.log(counts[seen] / total / before[seen])).sum() > LEAST_DIVERGENCE + seen.sum():
                while key not in kept:  # with all its suffixes
                    kept.add(key)
                    key = self._shorter(key, depth_of[key])
        order = sorted(kept)
        number = {key: i for i, key in enumerate(order)}
        n = len(order)
        self.longer = np.repeat(np.arange(n, 2 * n, dtype=np.int32)[None], 2, axis=0).reshape(-1)[:, None].repeat(SYMBOLS, axis=1)
        for key in order:
            if key != 1:
                d = depth_of[key]
                self.longer[number[self._shorter(key, d)], key >> 6 * (d - 1) & 63] = number[key]
        self.longer = np.ascontiguousarray(self.longer).reshape(-1)
        logs = np.log10(np.stack([shares[key] for key in order]))
        logs[:, RARE] -= np.log10(max(1, int((alphabet == RARE).sum())))
        self.logs = np.concatenate((logs, logs)).astype(np.float32).reshape(-1)
        self.states = n

    @staticmethod
    def _shorter(key: int, depth: int) -> int:
        bit = 1 << 6 * (depth - 1)
        return key & (bit - 1) | bit

    def token_scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each token: a text's words in order, then its end."""
        stream, starts = _stream(texts)
        windows = _windows(stream)[_scored(starts, len(stream))]
        return _token_sums(windows, self.window_scores(windows))

    def window_scores(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of each window's last byte after those before."""
        state = np.zeros(len(windows), np.int32)
        for back in range(DEPTH + 1):
            symbols = self.symbol[(windows >> U64(8 * back) & U64(255)).astype(np.int64)].astype(np.int32)
            if back:
                state = self.longer[state * SYMBOLS + symbols]
            else:
                last = symbols
        return self.logs[state * SYMBOLS + last].astype(np.float64)


def _token_sums(windows: np.ndarray, values: np.ndarray) -> np.ndarray:
    last = windows & U64(255)
    return np.diff(np.cumsum(values)[(last == U64(_SPACE)) | (last == U64(_NEWLINE))], prepend=0.0)


def _alphabet(counts: np.ndarray) -> np.ndarray:
    """Symbols of bytes: those of the two ends, then by frequency, and one for all rare bytes."""
    symbol = np.full(256, RARE, np.uint8)
    own = [b for b in np.argsort(-counts, kind="stable").tolist() if counts[b] and b not in (_SPACE, _NEWLINE)]
    symbol[own[: RARE - 2]] = np.arange(2, 2 + len(own[: RARE - 2]))
    symbol[_SPACE], symbol[_NEWLINE] = WORD_END, TEXT_END
    return symbol


def context_counts(windows: DataFrame, least_share: float = 0.0) -> tuple[np.ndarray, DataFrame]:
    """Symbols of bytes, and (context, next, n) of counted windows (key, n): contexts seen often enough, with their next symbols."""
    by_byte = np.zeros(256, np.int64)
    for r in windows.groupBy(F.expr("cast(key & 255 as int)").alias("b")).agg(F.sum("n").alias("n")).collect():
        by_byte[r.b] = r.n
    symbol = _alphabet(by_byte)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy()
            packed = np.zeros(len(key), np.int64)
            last = symbol[(key & U64(255)).astype(np.int64)].astype(np.int64)
            for k in range(DEPTH + 1):
                if k:
                    packed |= symbol[(key >> U64(8 * k) & U64(255)).astype(np.int64)].astype(np.int64) << 6 * (k - 1)
                keys, sums = _totals((packed | 1 << 6 * k) << 6 | last, n)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 6), pa.array((keys & 63).astype(np.int32)), pa.array(sums)], ["context", "next", "n"])

    rows = windows.select("key", "n").mapInArrow(bounded(contexts), "context long, next int, n long").groupBy("context", "next").agg(F.sum("n").alias("n"))
    rows = written(rows, "contexts")
    least = max(float(LEAST_COUNT), least_share * float(by_byte.sum()))
    frequent = rows.groupBy("context").agg(F.sum("n").alias("m")).filter(F.col("m") >= least).select("context")
    return symbol, rows.join(frequent, "context", "left_semi")


def _by_context(context: list[int], following: list[int], n: list[int]) -> dict[int, np.ndarray]:
    found: dict[int, np.ndarray] = {}
    for c, f, m in zip(context, following, n, strict=True):
        found.setdefault(c, np.zeros(SYMBOLS))[f] += m
    return found


def fit_tree(windows: DataFrame, least_share: float = 0.0) -> SuffixTree:
    """The whole tree of counted windows (key, n), for small tables."""
    symbol, rows = context_counts(windows, least_share)
    got = rows.toPandas()
    return SuffixTree(symbol, _by_context(got["context"].tolist(), got["next"].tolist(), got["n"].tolist()))


def byte_scores(windows: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, logp) of all rows of ``asked`` (key): a mixed window, and its last byte's log10 probability by the tree of ``windows``.

    Contexts and windows meet by their last two symbols, so a part of the tree is bounded by the alphabet.
    """
    symbol, rows = context_counts(windows)
    first = [(r.context, r.next, r.n) for r in rows.filter("context < 4096").collect()]  # none, or one symbol
    table = F.array(*(F.lit(int(x)) for x in symbol))
    pair = lambda key: F.get(table, key(1)) + F.get(table, key(2)) * 64
    own = rows.filter("context >= 4096").select(F.col("context").bitwiseAND(F.lit(4095)).cast("int").alias("pair"), "context", "next", "n")
    questions = asked.select(pair(lambda k: F.shiftrightunsigned("key", 8 * k).bitwiseAND(F.lit(255)).cast("int")).cast("int").alias("pair"), "key")

    def answer(contexts: pa.Table, windows: pa.Table) -> pa.Table:
        keys = windows.column("key").to_numpy().view(U64)
        if len(keys):
            rows = [contexts.column(c).to_pylist() + [x[i] for x in first] for i, c in enumerate(("context", "next", "n"))]
            values = SuffixTree(symbol, _by_context(*rows), True).window_scores(keys)
        else:
            values = np.zeros(0)
        return pa.table({"word": pa.array(mix(keys).view(np.int64)), "logp": pa.array(values, pa.float64())})

    return own.groupBy("pair").cogroup(questions.groupBy("pair")).applyInArrow(answer, "word long, logp double")


def _unpacked(data: bytes) -> list[bytes]:
    raw = _plain(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.int64, n + 1)) - n + 8 * (n + 1)
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _scored_windows(texts: list[bytes]) -> list[np.ndarray]:
    out = []
    for a, b in _pieces(texts):
        stream, starts = _stream(texts[a:b])
        out.append(_windows(stream)[_scored(starts, len(stream))])
    return out


def _window_keys(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and the turned keys by which they are sorted."""
    windows = _set(np.concatenate([_set(x) for x in windows]))
    keys = _turned(mix(windows))
    order = np.argsort(keys)
    return windows[order], keys[order]


def _finder(listed: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function of numbers that are all listed to their places in the list.

    A table has a place by hash, with eight slots or more for each number; those whose slot another one has are searched for.
    """
    shift = U64(64 - max(8, len(listed).bit_length() + 3))
    slot = lambda x: (x * U64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    table = np.zeros(1 << 64 - int(shift), np.int32)
    table[slot(listed)] = np.arange(len(listed))
    order = np.argsort(listed)
    ascending = listed[order]

    def find(x: np.ndarray) -> np.ndarray:
        at = table[slot(x)]
        other = np.flatnonzero(listed[at] != x)
        at[other] = order[np.searchsorted(ascending, x[other])]
        return at

    return find


def score_texts(docs: DataFrame, train: DataFrame, learned: Column | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, learned from ``train``'s texts.

    Both have doc_id and text (null: empty); other columns are ignored. Where ``train`` is rows of ``docs``, ``learned`` says
    which: then everything is counted and listed in one pass over ``docs``, with the same results. A-Z count as small letters;
    tokens are words between white space, then one end. ``base_score`` is the smoothed unigram
    score. ``score`` is the model's log10 probability of the whole text: a token's count in training
    less an absolute discount (Ney's estimate from words seen once and twice), whose sum goes to
    words by the suffix tree's probability of their symbols; after words that are a context, the same
    with what was counted there, the rest going to the shorter context's. Words are known by 64-bit hashes. Documents are put into
    blocks of about 4 MB. A block asks for its distinct words, grams, contexts and windows, by shards of their keys, with its own
    counts; a shard adds up the blocks' counts and answers in the order of the keys, so a gram is one key for each block that
    has it and no table of grams is kept. Repeated rows and null ids are scored like any other;
    with no training rows everything is unseen; an empty table gives an empty table.
    """
    row = lambda rows, ours, wanted: rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ours.alias("learned"), F.lit(wanted).alias("wanted"))
    if learned is None:
        rows = row(train, F.lit(True), False).unionAll(row(docs, F.lit(False), True))
    else:
        rows = row(docs, F.coalesce(learned, F.lit(False)), True)
    counts = written(corpus_counts(rows.select("text", "learned")), "counts")
    words = counts.filter("NOT window").select(F.col("key").alias("word"), F.col("n").alias("c"))
    windows = counts.filter("window")
    spelled = written(byte_scores(windows.filter("n > 0").select("key", "n"), windows.select("key")), "spelled")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.max(F.when(F.col("word") == 0, F.col("c"))), F.lit(0)).alias("ends"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    n, v, ends = int(sums.n), int(sums.v), int(sums.ends)
    discount = _discount(int(sums.once), int(sums.twice))
    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(_blocks(rows), "blocks")
    answers, contexts = gram_counts(blocks, shards)
    seen_by = {r.kind: (r.once, r.twice) for r in answers.groupBy("kind").agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).collect()}
    discounts = [_discount(*seen_by.get(k, (0, 0))) for k in range(1, WORD_DEPTH + 1)]
    answers = answers.drop("once", "twice")
    states = written(word_tree(words, contexts, shards), "states")
    whole = np.log10(n + SMALL * (v + 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _turned(batch.column(0).to_numpy().view(U64))
            order = np.argsort(keys)
            edge = _sharded(keys[order], shards).tolist()
            values = batch.column(1).to_numpy()[order].astype(np.float32)
            rows = [{"shard": s, "keys": _shrunk(keys[order[a:b]]), "found": _shrunk(values[a:b])} for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
            yield from _rows(rows, "shard int, keys binary, found binary").to_batches()

    def key_rows(block: int, keys: np.ndarray) -> pa.Table:
        edge = _sharded(keys, shards).tolist()
        return _rows([{"shard": s, "block": block, "keys": _shrunk(keys[a:b])} for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a], "shard int, block long, keys binary")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from key_rows(block, _window_keys(_scored_windows(_unpacked(data.as_py())))[1]).to_batches()

    def replies(asked: DataFrame, table: DataFrame, number: int) -> DataFrame:
        kind = np.float32 if number == WINDOW else np.int64

        def reply(asked: pa.Table, known: pa.Table) -> pa.Table:
            keys, found = _joined(known.column("keys"), U64), _joined(known.column("found"), kind)
            order = np.argsort(keys)
            keys, found = np.append(keys[order], U64(2**64 - 1)), np.append(found[order], kind(0))
            rows = []
            for shard, block, x in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "keys")), strict=True):
                wanted = _grown(x, U64)
                at = np.searchsorted(keys[:-1], wanted)
                rows.append({"block": block, "kind": number, "shard": shard, "data": _shrunk(np.where(keys[at] == wanted, found[at], kind(0)))})
            return _rows(rows, _ANSWERS)

        return asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(reply, _ANSWERS)

    def ask_states(own: pa.Table, seen: pa.Table) -> pa.Table:
        return key_rows(own.column("block")[0].as_py(), _opened(own, seen)[1].contexts())

    spellings = written(spelled.select("word", "logp").mapInArrow(bounded(pack), "shard int, keys binary, found binary"), "spellings")

    def score(own: pa.Table, seen: pa.Table) -> pa.Table:
        texts, block, found = _opened(own, seen)
        wanted = np.frombuffer(own.column("wanted")[0].as_py(), bool)
        ids, sizes, stop = own.column("ids")[0].as_py(), block.sizes, block.stop
        windows = _scored_windows(texts)
        listed = _window_keys(windows)[0]
        place_of = _finder(listed)
        own_scores = np.concatenate([_token_sums(x, found[WINDOW][place_of(x)].astype(np.float64)) for x in windows])
        token_counts = np.where(block.is_word, block.counts[0], ends)
        base = np.log10(token_counts + SMALL) - whole
        columns = [sizes + 1, np.add.reduceat(token_counts > 0, stop - sizes - 1, dtype=np.int64), np.full(len(sizes), n), np.add.reduceat(base, stop - sizes - 1)]
        if n:
            share = (np.maximum(token_counts - discount, 0) + discount * v * 10.0**own_scores) / n
            contexts = block.contexts()
            for depth, d in enumerate(discounts, 1):
                often = np.flatnonzero(block.follows(depth))
                place, context = block.levels[depth][0][often], block.levels[depth][1][often]
                kinds = found.get(STATE, contexts)[np.searchsorted(contexts, _turned(context))]  # no contexts, no answer
                place, kinds = place[kinds > 0], kinds[kinds > 0]
                share[place] = (np.maximum(block.counts[depth][place] - d, 0) + d * kinds * share[place]) / block.counts[depth - 1][place - 1]
            own_scores = np.log10(share)
        columns.append(np.add.reduceat(own_scores, stop - sizes - 1))
        kept = [pa.array(x[wanted]) for x in columns]
        return pa.Table.from_arrays([pa.array([x for x, w in zip(ids, wanted.tolist(), strict=True) if w], pa.int64()), *kept], names=SCORED)

    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    key_table = "shard int, block long, keys binary"
    scored = None
    for turn in range(ROUNDS):  # what a round shuffles goes before the next one
        mine = lambda rows, turn=turn: rows.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn)
        some, counted = mine(blocks), mine(answers)
        asked = some.groupBy("block").cogroup(counted.filter(F.col("kind") < WORD_DEPTH).groupBy("block")).applyInArrow(ask_states, key_table)
        counted = counted.unionAll(written(replies(asked, states, STATE), "replies"))
        counted = counted.unionAll(replies(some.select("block", "data").mapInArrow(bounded(ask), key_table), spellings, WINDOW))
        part = written(some.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, kinds), "scores")
        scored = part if scored is None else scored.unionAll(part)
    return scored


SCORED = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
