"""Exact search for the greatest inner products: vectors in buckets by length, pruned by local cosine thresholds, then verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, written
from .vectors import matrix, whole_vectors

#: Vectors of a bucket, and bytes beyond which it is cut earlier.
BUCKET_ROWS, BUCKET_BYTES = 2048, 4 << 20
#: Bytes of queries that a pass over the buckets takes to every task; any number of passes follow each other.
BLOCK_BYTES = 16 << 20
#: From this cosine on that a bucket asks of a query's partners, its coordinates choose candidates; below it lengths alone do.
COORDINATES_FROM = 0.8
#: Coordinates that are looked at, those in which the query is largest.
FOCUS = 3
#: Queries whose products with a bucket are held at a time.
CHUNK = 256
#: Relative slack of comparisons of rounded numbers; what it lets through is verified by exact products.
SLACK = 1e-9
LOWEST = np.iinfo(np.int64).min


def products(queries: np.ndarray, vectors: np.ndarray, limit: float) -> np.ndarray:
    """Exact inner products of rows of whole numbers; no sum of absolute values exceeds ``limit``."""
    width = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :width], vectors[:, :width].T
    if limit < 2**53:
        return a @ b
    whole = np.vectorize(int, otypes=[object])
    out = (whole(a) @ whole(b) if a.size and b.size else np.zeros((len(a), b.shape[1]), object)).astype(object)
    if any(abs(x) >= 2**63 for x in out.flat):
        raise ValueError("a score doesn't fit a long")
    return out.astype(np.int64)


class Bucket:
    """Vectors of neighbouring lengths, longest first."""

    def __init__(self, ids: bytes, x: bytes, dims: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = np.frombuffer(x, "<f8").reshape(len(self.ids), dims)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        self.directions = self.x / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_by(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of coordinate c of the directions, and its values."""
        if c not in self.lists:
            order = np.argsort(self.directions[:, c])
            self.lists[c] = order, self.directions[order, c]
        return self.lists[c]

    def near(self, direction: np.ndarray, cosine: float) -> np.ndarray:
        """Places of the vectors whose largest coordinates of the query allow an angle of that cosine.

        A vector within angle alpha of the query, whose angle to an axis is beta, has an angle between
        beta - alpha and beta + alpha to that axis.
        """
        width = min(len(direction), self.x.shape[1])
        alpha = np.arccos(min(cosine, 1.0)) + 1e-7
        axes = np.argsort(-np.abs(direction[:width]), kind="stable")[:FOCUS].tolist()
        spans = []
        for c in axes:
            beta = np.arccos(np.clip(direction[c], -1, 1))
            low = np.cos(beta + alpha) - SLACK if beta + alpha < np.pi else -2.0
            high = np.cos(beta - alpha) + SLACK if beta > alpha else 2.0
            order, values = self.sorted_by(c)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            spans.append((b - a, c, order[a:b], low, high))
        if not spans:
            return np.arange(len(self.ids))
        _, first, places, *_ = min(spans, key=lambda s: s[0])
        for _, c, _, low, high in spans:
            if c != first:
                places = places[(self.directions[places, c] >= low) & (self.directions[places, c] <= high)]
        return places


class Search:
    """The k best of a block of queries among the buckets seen so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
        self.floor = np.full(len(ids), LOWEST)  # what a score must reach
        self.full = np.zeros(len(ids), bool)  # whether ``floor`` is of k others
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # query's place, score, id

    def learn(self, bucket: Bucket) -> None:
        """Takes thresholds from a bucket that is yet to be searched."""
        self._all(bucket, np.arange(len(self.ids)), np.full(len(self.ids), len(bucket.ids)), keep=False)

    def visit(self, bucket: Bucket) -> None:
        """Searches a bucket: prunes it by its longest vector's cosine threshold, else by coordinates or by lengths."""
        if not len(bucket.ids) or not len(self.ids):
            return
        reach = self.lengths * bucket.lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(self.full & (self.floor > 0), self.floor / reach, -1.0)  # no vector reaches it: infinite
            shortest = np.where(cosine > 0, self.floor / self.lengths * (1 - SLACK), 0.0)
        open_ = cosine <= 1 + SLACK
        closely = open_ & (cosine >= COORDINATES_FROM)
        some = np.flatnonzero(closely)
        for at in range(0, len(some), CHUNK):
            self._few(bucket, some[at : at + CHUNK], cosine)
        rest = np.flatnonzero(open_ & ~closely)
        counts = np.searchsorted(-bucket.lengths, -shortest[rest], "right")
        order = np.argsort(counts, kind="stable")
        self._all(bucket, rest[order], counts[order], keep=True)

    def _few(self, bucket: Bucket, queries: np.ndarray, cosine: np.ndarray) -> None:
        who, scores, ids = [], [], []
        for q in queries.tolist():
            places = bucket.near(self.x[q] / self.lengths[q], cosine[q] * (1 - SLACK))
            got = products(self.x[q : q + 1], bucket.x[places], self.lengths[q] * bucket.lengths[0] * (1 + SLACK))[0]
            good = (got >= self.floor[q]) & (bucket.ids[places] != self.ids[q])
            who.append(np.full(int(good.sum()), q))
            scores.append(got[good].astype(np.int64))
            ids.append(bucket.ids[places[good]])
        self._merge(np.concatenate(who), np.concatenate(scores), np.concatenate(ids))

    def _all(self, bucket: Bucket, queries: np.ndarray, counts: np.ndarray, keep: bool) -> None:
        """Products of each query with the first vectors, ``counts`` at least."""
        for at in range(0, len(queries), CHUNK):
            some = queries[at : at + CHUNK]
            n = int(counts[at : at + CHUNK].max())
            if not n:
                continue
            got = products(self.x[some], bucket.x[:n], float(self.lengths[some].max() * bucket.lengths[0]) * (1 + SLACK))
            other = bucket.ids[:n] != self.ids[some, None]
            least = np.where(self.full[some], self.floor[some], LOWEST)
            if n > self.k:  # k others, as at most one id is the query's own, unless it is repeated
                masked = np.where(other, got, got.dtype.type(-np.inf if got.dtype.kind == "f" else LOWEST))
                kth = np.partition(masked, n - self.k, axis=1)[:, n - self.k]
                enough = other.sum(axis=1) >= self.k
                whole = np.where(enough, kth, 0).astype(np.int64)
                least = np.where(enough, np.maximum(least, whole), least)
                if not keep:
                    self.floor[some] = least
                    self.full[some] |= enough
            if keep:
                row, column = np.nonzero((got >= least[:, None]) & other)
                self._merge(some[row], got[row, column].astype(np.int64), bucket.ids[column])

    def _merge(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        touched = np.zeros(len(self.ids), bool)
        touched[who] = True
        old = touched[self.found[0]]
        who, scores, ids = (np.concatenate([a[old], b]) for a, b in zip(self.found, (who, scores, ids), strict=True))
        order = np.lexsort((ids, ~scores, who))
        who, scores, ids = who[order], scores[order], ids[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        best = rank < self.k
        last = rank == self.k - 1
        self.floor[who[last]] = np.maximum(self.floor[who[last]], scores[last])
        self.full[who[last]] = True
        self.found = tuple(np.concatenate([a[~old], b[best]]) for a, b in zip(self.found, (who, scores, ids), strict=True))


def length_buckets(vectors: DataFrame) -> DataFrame:
    """Rows (longest double, n int, dims int, ids binary, x binary) of buckets: rows are dealt by ranges of length, then id, so that equal lengths are split too.

    ``vectors`` has id, dims and x.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(2), dims, int(dims.max(initial=0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.einsum("ij,ij->i", x, x)))], ["id", "dims", "x", "length"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            dims = table["dims"].to_numpy()
            width = int(dims.max(initial=0))
            x = matrix(table["x"], dims, width)
            columns = [table["length"][0].as_py()], [len(dims)], [width], [table["id"].to_numpy().astype("<i8").tobytes()], [x.astype("<f8", copy=False).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["longest", "n", "dims", "ids", "x"])

        held: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            while batch.num_rows:
                each = max(1, batch.nbytes // batch.num_rows)
                take = max(1, min(batch.num_rows, BUCKET_ROWS - n, (BUCKET_BYTES - size) // each))
                held.append(batch.slice(0, take))
                n, size, batch = n + take, size + take * each, batch.slice(take)
                if n >= BUCKET_ROWS or size + each > BUCKET_BYTES:
                    yield made(held)
                    held, n, size = [], 0, 0
        if held:
            yield made(held)

    rows = vectors.select("id", "dims", "x").mapInArrow(bounded(lengths), "id long, dims int, x binary, length double")
    dealt = rows.repartitionByRange(F.desc("length"), F.col("id")).sortWithinPartitions(F.desc("length"), F.col("id"))
    return dealt.mapInArrow(bounded(pack), "longest double, n int, dims int, ids binary, x binary")


def search_block(buckets: DataFrame, longest: tuple | None, block: pa.Table, k: int) -> DataFrame:
    """query_id, vec_id, score: what each task found best for each query of a block, which goes to every task."""
    dims = block["dims"].to_numpy()
    ids, x = block["id"].to_numpy().astype(np.int64), matrix(block["x"].combine_chunks(), dims, int(dims.max(initial=0)))
    sent = buckets.sparkSession.sparkContext.broadcast((ids, x, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            for n, width, own, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if search is None:
                    ids, x, longest = sent.value
                    search = Search(ids, x, k)
                    if longest:
                        search.learn(Bucket(*longest))
                if n:
                    search.visit(Bucket(own, data, width))
        if search:
            who, scores, ids = search.found
            good = scores >= search.floor[who]
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[who[good]]), pa.array(ids[good]), pa.array(scores[good])], ["query_id", "vec_id", "score"])

    return buckets.select("n", "dims", "ids", "x").mapInArrow(bounded(run), "query_id long, vec_id long, score long")


def top_products(queries: DataFrame, vectors: DataFrame, k: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k greatest inner products of each query with the vectors of other ids: query_id, rank int (from 1), vec_id, score long.

    Both tables have columns ``vec_id`` and ``vector``; others are ignored. Components are
    floor(scale * component); scores are exact, ties go to the smaller id, then rank as they come. Rows
    without an id, and vectors that are null or hold null or non-finite components, take no part.
    Vectors of other lengths are compared as if they ended with zeros, so an empty one scores 0.
    Repeated rows are candidates each; queries with equal ids are one query, equal ones count once,
    and rows of a query's own id are no candidates of it. Empty tables give an empty result. A score
    that doesn't fit a long raises an error.

    The vectors lie in buckets by length in a table in the shared folder. Queries go to all tasks in
    blocks of ``BLOCK_BYTES``, one pass over the buckets for each, whose thresholds begin with those of
    the longest bucket; a task keeps k results a query. No pair of rows is shuffled, only these.
    """
    spark = vectors.sparkSession
    renamed = [t.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")).filter("id is not null") for t in (queries, vectors)]
    asked = written(whole_vectors(renamed[0], "vector", scale, "id").dropDuplicates(["id", "x"]), "queries")
    buckets = written(length_buckets(whole_vectors(renamed[1], "vector", scale, "id")), "buckets")
    size = asked.agg(F.sum(F.octet_length("x") + 8)).first()[0] or 0
    top = buckets.agg(F.max("longest")).first()[0]
    longest = None if top is None else tuple(buckets.filter(F.col("longest") == top).select("ids", "x", "dims").first())
    blocks = -(-size // BLOCK_BYTES)
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", "x"), F.lit(blocks)) == block).toArrow()
        made = written(search_block(buckets, longest, part, k), "found")
        found = made if found is None else found.unionAll(made)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
