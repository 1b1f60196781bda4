"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels every node of ``edges`` (a long, b long) with the smallest node it reaches.

    Returns (node, component) for each node that has an edge to another one. Self-loops, repeated
    edges and nulls are ignored; an empty table gives an empty table. Each round is two grouped
    minima and joins, its result written to the shared folder, so no node's neighbours meet in one
    task's memory; rounds grow with the logarithm of the longest path. A round that changes
    nothing ends the work; hitting ``max_rounds`` first raises an error.
    """
    now = written(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _fingerprint(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        now = written(small, "edges")
        before, state = state, _fingerprint(now)
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.expr("bit_xor(xxhash64(a, b))").alias("x"),
        F.sum(F.expr("xxhash64(b, a) % 1000003")).alias("s"),
    ).first()
    return tuple(row)
