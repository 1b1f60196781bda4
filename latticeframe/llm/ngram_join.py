"""Exact self-join of documents on the Jaccard likeness of their word n-gram sets.

How it works:

1. *Copies.* Documents with equal sets form one class; only its smallest id goes on.
2. *Routing.* Under any total order of the shingles, two sets with J >= t share one of the first
   ``n - ceil(t n) + 1`` shingles of each (the prefix principle). Rare shingles come first: a
   count sketch of fixed size ranks shingles that stand out as frequent last. A shingle that
   two or more prefixes hold makes a block.
3. *Stars.* In each block every document has a hub of like size, one that shares many blocks. A
   document is compared with the hub that it shares most blocks with, by exact verification. This
   joins dense groups of near copies with one pair for each document.
4. *Count-vector R-tree.* Blocks that still hold several components are searched with an R-tree,
   those with the same leading document (of most shared blocks) as one:
   shingles are hashed into groups, a document is the point of its group counts, boxes keep the
   largest count of each group, and the sum of coordinate minima bounds the overlap. Only pairs of
   different components are followed; large blocks are cut into chunks by size and component and
   searched chunk by chunk. Surviving pairs are verified exactly, the likeliest between two components first, the
   others if that one fails.
5. *Components* over the verified links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shared import bounded, quoted, written
from .shingles import shingle_sets

#: log2 of the sketch's counters: 1 MB of 32-bit counts, whatever the input's size.
SKETCH_BITS = 18
#: A document has so many groups for a shingle, and 16 groups at least; the tree's points have an eighth of them.
GROUPS = 2
COARSER = 8
#: Documents of a block that meet in one task of the R-tree search.
CHUNK_DOCS = 1024
FAN_OUT = 16
#: Pairs of one document that a task verifies.
HUB_PAIRS = 256


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of all shingles by the top bits of their hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(_as_bytes(batch.column(0)), width):
                slots = (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                if len(s) > 4096:
                    total += np.bincount(slots, minlength=len(total))
                else:
                    np.add.at(total, slots, 1)
        yield pa.RecordBatch.from_pydict({"c": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for c in batch.column(0).to_pylist():
                total += np.frombuffer(c, np.int64)
        yield pa.RecordBatch.from_pydict({"c": [total.tobytes()]})

    # three levels, so that neither one task nor the driver reads a sketch from each partition
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select("text").mapInArrow(bounded(count), "c binary")
    for k in (n, math.isqrt(n) + 1):
        parts = parts.repartition(k).mapInArrow(bounded(add), "c binary")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in parts.toLocalIterator():
        total += np.frombuffer(row.c, np.int64)
    return total


def _classes_of_slots(total: np.ndarray) -> np.ndarray:
    """0 for slots that don't stand out, then 1 + log2 of what is above the mean."""
    mean = total.mean()
    above = total - mean
    return np.where(above > 6 * max(mean, 1) ** 0.5, np.log2(np.maximum(above, 1)).astype(int) + 1, 0).astype(np.uint8)


def _groups(n: int) -> int:
    return max(16, 1 << max(0, (GROUPS * n - 1).bit_length()))


def count_vector(s: np.ndarray) -> bytes:
    """Counts of a set's members by group, 3 at most, in two bits each; the number of groups is a power of two."""
    g = _groups(len(s))
    counts = np.bincount((s >> np.uint64(64 - (g.bit_length() - 1))).astype(np.int64), minlength=g)
    four = np.minimum(counts, 3).astype(np.uint8).reshape(-1, 4)
    return (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def counts_of(vector: bytes) -> np.ndarray:
    """The counts of a vector. Members beyond 3 of a group aren't in it; a set has as many as its size
    exceeds their sum, and an overlap may exceed its bound by those of both."""
    packed = np.frombuffer(vector, np.uint8)
    return (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(-1)


def fold(v: np.ndarray, g: int) -> np.ndarray:
    """Count vectors (in rows) with ``g`` groups, by adding neighbouring ones."""
    n = v.shape[-1]
    return v if n == g else v.reshape(*v.shape[:-1], g, n // g).sum(axis=-1, dtype=np.int32)


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, prefix, vec) of every document with an id; ``prefix`` holds the shingles to route by."""
    slots = _classes_of_slots(_sketch(docs, width))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sigs, prefixes, vecs = [], [], [], []
            for s in shingle_sets(_as_bytes(batch.column(1)), width):
                n = len(s)
                ns.append(n)
                sigs.append(hashlib.md5(s.tobytes()).digest())
                if not n:
                    prefixes.append(np.zeros(0, np.int64))
                    vecs.append(b"")
                    continue
                p = n - (percent * n + 99) // 100 + 1
                kind = slots[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if kind.any():
                    kept = s[np.argsort(kind, kind="stable")[:p]]
                else:
                    kept = s[:p]
                prefixes.append(kept.view(np.int64))
                vecs.append(count_vector(s))
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ns, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.array(vecs, pa.binary()),
                ],
                ["doc_id", "n", "sig", "prefix", "vec"],
            )

    return docs.select("doc_id", "text").mapInArrow(bounded(make), "doc_id long, n long, sig binary, prefix array<long>, vec binary")


def _shared_rows(routed: DataFrame) -> DataFrame:
    """(token, doc, n): the rows of blocks of two documents or more.

    A streaming pass over each partition, sorted by shingle. Only neighbouring rows are looked at
    together, never the block.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which may begin the next batch's block
        carried = False  # whether that row has been handed on
        for batch in batches:
            table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            token = table.column(0).to_numpy()
            same = token[1:] == token[:-1]
            keep = np.zeros(len(token), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                keep[0] = bool(len(same) and same[0]) and not carried
            last = len(token) - 1
            carried = bool(keep[last])
            rows = table.to_batches()
            held = rows[-1].slice(len(rows[-1]) - 1) if rows else held
            for part in table.filter(pa.array(keep)).to_batches():
                yield part

    return routed.select("token", "doc", "n").mapInArrow(bounded(scan), "token long, doc long, n long")


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each document b the hub a that it shares most blocks with. ``degree`` is the number of a document's blocks.

    A block's hubs are its documents with the most shared blocks, one for each range of like sizes:
    a text that many are edited from has all their common shingles. A task keeps only the hubs of
    the block at hand.
    """
    ordered = rows.select("token", "doc", "n", "degree").repartition("token").sortWithinPartitions("token", F.desc("degree"), "doc")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, hubs = None, []  # the hubs' ids and sizes
        for batch in batches:
            left, right, sizes = [], [], []
            for t, d, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if t != token:
                    token, hubs = t, []
                for hub, size in hubs:
                    if 100 * size >= percent * n and 100 * n >= percent * size:
                        left.append(hub)
                        right.append(d)
                        sizes.append(n)
                        break
                else:
                    hubs.append((d, n))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, sizes)], ["a", "b", "n"])

    # a pair that shares few blocks for its size is left to the search
    tried = ordered.mapInArrow(bounded(assign), "a long, b long, n long").groupBy("a", "b").agg(F.count("*").alias("m"), F.max("n").alias("n")).filter(F.col("m") * 500 >= F.col("n") * (100 - percent))
    return tried.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets reach the likeness, by their whole sets.

    Texts are shuffled, which are smaller than their sets, once by document and once to the pair's
    ``a``. A task reads the pairs of one ``a`` after that document itself and holds one set at a time;
    an ``a`` with many pairs is dealt to several tasks.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # a table of 2**20 rows at most; it keeps other texts out of the shuffle
    slot = F.expr("pmod(xxhash64(doc_id), 1048576)")
    marks = nodes.select(slot.cast("int").alias("slot")).distinct()
    texts = docs.select("doc_id", "text").filter("doc_id IS NOT NULL").withColumn("slot", slot.cast("int")).join(F.broadcast(marks), "slot", "left_semi").drop("slot")
    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts")), "hubs")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    asked = pairs.join(hubs, "a").select("a", part, "b", F.col("b").alias("doc_id"))
    # repeated ids: rows that share an id count as one node; each of them is compared
    asked = asked.union(hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")))
    rows = asked.join(texts, "doc_id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def linked(own: np.ndarray, hub: np.ndarray) -> bool:
        if min(len(own), len(hub)) * 100 < percent * max(len(own), len(hub)):
            return False
        both = int((np.diff(np.sort(np.concatenate((own, hub)))) == 0).sum())
        return both > 0 and 100 * both >= percent * (len(own) + len(hub) - both)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hubs = None, []  # one set, or several where an id is repeated with other texts
        for batch in batches:
            left, right = [], []
            columns = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(_as_bytes(batch.column(3)), width), strict=True)
            for a, part, b, own in columns:
                if b is None:
                    if key != (a, part):
                        key, hubs = (a, part), []
                    if not any(np.array_equal(own, hub) for hub in hubs):
                        hubs.append(own)
                elif key == (a, part) and any(linked(own, hub) for hub in hubs):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.mapInArrow(bounded(verify), "a long, b long").distinct()


class CountTree:
    """An R-tree over group-count points of like dimension, packed in the order given.

    Inner boxes keep, for each group, the largest count below them, and the range of set sizes.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            hi, low, high = self.levels[-1]
            cut = np.arange(0, len(hi), FAN_OUT)
            self.levels.append((np.maximum.reduceat(hi, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    def search(self, point: np.ndarray, size: int, percent: int, slack: int = 0) -> np.ndarray:
        """Positions of the points that may reach the likeness with ``point``, where ``slack`` members of the sets aren't counted."""
        at = np.zeros(min(1, len(self.levels[-1][0])), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low, high = self.levels[depth]
            at = at[(high[at] * 100 >= percent * size) & (low[at] * percent <= 100 * size)]
            if len(at):
                sums = np.minimum(hi[at], point).sum(axis=1, dtype=np.int64)
                at = at[(sums + slack) * (100 + percent) >= percent * (size + low[at])]
            if not len(at) or not depth:
                return at
            at = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            at = at[at < len(self.levels[depth - 1][0])]
        return at


def tree_pairs(n: np.ndarray, comp: np.ndarray, vecs: list[bytes], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """(i, j, thousandths of the larger set that the bound allows), i in ``left`` (queries), j in ``right`` (indexed), of different components that pass the bound.

    One tree of coarse points for each octave of sizes; what it leaves is bounded by the fine counts.
    """
    out = []
    counts = [counts_of(v) for v in vecs]
    lost = n - np.array([c.sum(dtype=np.int64) for c in counts])
    octave = np.array([int(x).bit_length() for x in n])
    for k in np.unique(octave[right]):
        mine = right[octave[right] == k]
        asking = left[np.abs(octave[left] - k) <= 1]
        if not len(asking) or len(np.unique(np.concatenate((comp[mine], comp[asking])))) < 2:
            continue
        g = min(len(counts[i]) for i in mine)
        coarse = max(2, min(g, min(len(counts[i]) for i in asking)) // COARSER)
        mine = mine[np.lexsort((comp[mine], n[mine]))]
        fine = np.stack([fold(counts[i], g) for i in mine])
        tree = CountTree(fold(fine, coarse).astype(np.int32), n[mine])
        for i in asking:
            at = tree.search(fold(counts[i], coarse), int(n[i]), percent, int(lost[i] + lost[mine].max()))
            at = at[comp[mine[at]] != comp[i]]
            if not len(at):
                continue
            m = min(g, len(counts[i]))
            overlap = np.minimum(fold(fine[at], m), fold(counts[i], m)).sum(axis=1, dtype=np.int64)
            overlap += lost[mine[at]] + lost[i]
            size = n[mine[at]]
            keep = overlap * (100 + percent) >= percent * (n[i] + size)
            likely = 1000 * overlap // np.maximum(size, n[i])
            out += [(int(i), int(mine[x]), int(q)) for x, q in zip(at[keep], likely[keep], strict=True)]
    return out


def _searched(rows: DataFrame, vecs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components (ca, cb) that pass the R-tree bound, from all rows (token, doc, n, comp)."""
    # documents go on that have one of another component and of like size; sizes are alike only within neighbouring steps
    step = F.floor(F.log("n") / math.log(100 / percent)).cast("int").alias("step")
    rows = rows.withColumn("step", step)
    sizes = written(rows.groupBy("token", "step", "comp").agg(F.count("*").alias("m")), "sizes")
    spans = sizes.groupBy("token", "step").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    apart = [F.struct((F.col("step") + k).alias("step"), "x", "y", F.lit(k == 0).alias("own")) for k in (-1, 0, 1)]
    near = spans.select("token", F.explode(F.array(*apart)).alias("s")).groupBy("token", "s.step").agg(F.min("s.x").alias("x"), F.max("s.y").alias("y"), F.bool_or("s.own").alias("own"))
    parts = sizes.join(near.filter("x <> y AND own").select("token", "step"), ["token", "step"])
    whole = parts.groupBy("token").agg(F.sum("m").alias("all"))
    # a small block is one chunk; of a large one each step has its own, and a large component too, whose documents need no look at each other
    large = F.col("all") > CHUNK_DOCS
    alone = large & (F.col("m") * 2 >= CHUNK_DOCS)
    group = [F.when(large, F.col("step")).otherwise(0).alias("at"), alone.alias("alone"), F.when(alone, F.col("comp")).otherwise(0).alias("who")]
    parts = written(parts.join(whole, "token").select("token", "step", "comp", "m", *group), "parts")
    groups = parts.groupBy("token", "at", "alone", "who").agg(F.ceil(F.sum("m") / CHUNK_DOCS).cast("int").alias("chunks"))
    each = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    number = F.row_number().over(Window.partitionBy("token").orderBy("at", "alone", "who", "k"))
    each = written(each.withColumn("chunk", number), "chunks")
    placed_in = ["token", "at", "alone", "who"]
    chunked = rows.join(parts.drop("m"), ["token", "step", "comp"]).join(each.filter("k = 0").select(*placed_in, "chunks", F.col("chunk").alias("first")), placed_in)
    chunked = chunked.withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("doc"), F.col("chunks"))).cast("int")).select("token", "chunk", "doc", "n", "comp")
    chunked = written(chunked, "blocks")
    one, other = (each.select("token", F.col("chunk").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("at", "alone", "who"))) for c in ("ci", "cj"))
    same = "alone_ci AND alone_cj AND who_ci = who_cj"
    cells = one.join(other, "token").filter(f"ci <= cj AND at_cj <= at_ci + 1 AND NOT ({same})").select("token", "ci", "cj")
    sides = cells.select("token", "ci", "cj", F.explode(F.array_distinct(F.array("ci", "cj"))).alias("chunk"))
    # vectors come last: they are shuffled once by document and once to their cells
    placed = (
        chunked.join(sides, ["token", "chunk"])
        .join(vecs, ["doc", "n"])
        .select("token", "ci", "cj", "chunk", "doc", "n", "comp", "vec")
        .repartition("token", "ci", "cj")
        .sortWithinPartitions("token", "ci", "cj")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(table: pa.Table) -> list[tuple]:
            ci, cj, chunk = (table.column(i).to_numpy() for i in (1, 2, 3))
            doc, n, comp = (table.column(i).to_numpy() for i in (4, 5, 6))
            vec = table.column(7).to_pylist()
            left = np.flatnonzero(chunk == ci[0])
            right = np.flatnonzero(chunk == cj[0])
            hits = tree_pairs(n, comp, vec, left, right, percent)
            return [(doc[i], doc[j], comp[i], comp[j], k) if doc[i] < doc[j] else (doc[j], doc[i], comp[j], comp[i], k) for i, j, k in hits]

        def out(pairs: set) -> pa.RecordBatch:
            columns = list(zip(*pairs, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "ca", "cb", "likely"])

        held: list[pa.Table] = []
        found: set = set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                part = table.slice(s, e - s)
                if held and any(held[-1].column(i)[0] != part.column(i)[0] for i in range(3)):
                    found.update(run(pa.concat_tables(held)))
                    held = []
                held.append(part)
                if len(found) > 100_000:
                    yield out(found)
                    found = set()
        if held:
            found.update(run(pa.concat_tables(held)))
        yield out(found)

    found = placed.mapInArrow(bounded(search), "a long, b long, ca long, cb long, likely long")
    return found.groupBy("a", "b", "ca", "cb").agg(F.max("likely").alias("likely"))


def ngram_links(docs: DataFrame, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (doc_id, n, rep, sig) with each document's class, ``links`` (a, b) between classes.

    ``links`` connects the same classes as the set of all links with J >= percent / 100 does.
    """
    sets = written(_sets(docs, width, percent), "sets")
    # most documents are alone in their class; the others' classes are a table, so that a large class is a skewed join and no more
    alike = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    alike = written(alike.filter("rep <> last").select("sig", "rep"), "classes")
    members = sets.select("doc_id", "n", "sig").join(alike, "sig", "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), "sig")
    members = written(members, "members")
    copies = members.filter("doc_id <> rep").select("doc_id", "sig").distinct()
    # a table of 2**20 rows at most tells most documents apart from copies, so their sets aren't shuffled for that
    slot = F.expr("pmod(xxhash64(doc_id), 1048576)").cast("int")
    marks = F.broadcast(copies.select(slot.alias("slot")).distinct())
    known = sets.filter("n > 0 AND doc_id IS NOT NULL").withColumn("slot", slot)
    single = known.join(marks, "slot", "left_anti").unionByName(known.join(marks, "slot", "left_semi").join(copies, ["doc_id", "sig"], "left_anti")).drop("slot")
    # an id that is repeated with several texts has several vectors
    vecs = single.select(F.col("doc_id").alias("doc"), "n", "vec").dropDuplicates()
    routed = single.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("doc"), "n").repartition("token").sortWithinPartitions("token")
    shared = written(_shared_rows(routed), "shared")
    rows = written(shared.join(shared.groupBy("doc").agg(F.count("*").alias("degree")), "doc").select("token", "doc", "n", "degree"), "rows")
    one = written(_verified(written(_stars(rows, percent), "stars"), docs, width, percent), "links")
    labelled = _labelled(rows, connected_components(one))
    blocks = labelled.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("doc", F.struct(-F.col("degree"), "doc")).alias("lead"))
    # open blocks with the same leading document are searched as one, so a document is there once
    around = labelled.join(blocks.filter("x <> y").select("token", "lead"), "token").select(F.col("lead").alias("token"), "doc", "n", "comp").distinct()
    pairs = written(_searched(around, vecs, percent), "pairs")
    # first one pair between two components, the likeliest; then those that are still apart
    first = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max_by(F.struct("a", "b"), F.struct("likely", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b")
    two = written(_verified(written(first, "pairs"), docs, width, percent), "links")
    joined = connected_components(one.union(two))
    ends = pairs.join(first, ["a", "b"], "left_anti").select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    three = written(_verified(written(ends.filter("ca <> cb").select("a", "b"), "pairs"), docs, width, percent), "links")
    return members, one.union(two).union(three)


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, rows.doc == comps.node, "left").select("token", "doc", "n", "degree", F.coalesce("component", "doc").alias("comp"))


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """Groups documents linked by the Jaccard likeness of their distinct ``width``-word shingles.

    Takes a table with ``doc_id`` long and ``text`` string; other columns are ignored, whatever
    their names. Returns (doc_id, n_shingles, component_id) for each row: two documents link when
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id reachable by
    links. Texts are whole, with A-Z lower-cased; fewer words than ``width`` make one shingle;
    null, empty and blank texts have an empty set and link with nothing, not even each other. Rows
    that repeat a doc_id are each returned and count as one node. A row with a null doc_id is
    returned with its set size and a null component_id. An empty table gives an empty table.
    """
    members, links = ngram_links(docs, width, percent)
    # rows of one id in several classes join those classes
    split = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc_id", "a")
    same = members.join(split, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")
    comps = connected_components(links.union(same))
    return (
        members.join(comps, members.rep == comps.node, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the smallest of its component.

    See ``ngram_components``. Rows that share such an id stay together, rows without an id and texts
    without words all stay.
    """
    gone = ngram_components(docs, width, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*quoted(docs.columns))
