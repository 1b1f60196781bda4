"""Merkle trees over sections and paragraphs as document fingerprints.

A line is a section; its sentences are paragraphs, the leaves. A leaf's digest is the start of
SHA-256 of the leaf, a section's that of its leaves' digests in order, the root SHA-256 of the
sections'. Equal roots mean equal texts; of unequal ones only branches that differ need a look.

A fingerprint is a string: the root in hex, then for each section its digest and leaves, as in
``root|s:l,l|s:l``. Everything here is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .secrets import let

#: A leaf ends after a full stop, exclamation or question mark and white space, all of which it keeps.
LEAF_END = r"(?<=[.!?] )"
SECTION_END = r"(?<=\n)"
#: Hex digits of the digests of leaves and sections.
DIGITS = 12
#: Ranges of ids, for each shuffle partition, in which following documents are looked up.
RANGES_PER_PARTITION = 4
#: Relative error of the ranges' limits is 1 in so many.
RANGE_ACCURACY = 10_000


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fingerprint(text: Column) -> Column:
    """The tree of a text (null: empty) as a string. Inner digests are whole while the tree is built and shortened in the string."""

    def section(line: Column) -> Column:
        def joined(digests: Column) -> Column:
            short = F.array_join(F.transform(digests, lambda d: F.substring(d, 1, DIGITS)), ",")
            return F.struct(_digest(F.array_join(digests, ",")).alias("digest"), short.alias("leaves"))

        return let(F.transform(F.split(line, LEAF_END, -1), _digest), joined)

    def tree(found: Column) -> Column:
        top = _digest(F.array_join(F.transform(found, lambda s: s["digest"]), ","))
        return F.concat(top, F.lit("|"), F.array_join(F.transform(found, lambda s: F.concat(F.substring(s["digest"], 1, DIGITS), F.lit(":"), s["leaves"])), "|"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), SECTION_END, -1), section), tree)


def root(tree: Column) -> Column:
    return F.substring(tree, 1, 64)


def sections(tree: Column) -> Column:
    """``digest:leaf,leaf`` of each section."""
    return F.slice(F.split(tree, r"\|"), F.lit(2), F.size(F.split(tree, r"\|")))


def leaves(tree: Column) -> Column:
    return F.flatten(F.transform(sections(tree), lambda s: F.split(F.substring(s, DIGITS + 2, F.length(s)), ",")))


def nodes(tree: Column) -> Column:
    """Digests of the root, of the sections and of the leaves."""
    parts = lambda found: F.concat(F.transform(found, lambda s: F.substring(s, 1, DIGITS)), F.flatten(F.transform(found, lambda s: F.split(F.substring(s, DIGITS + 2, F.length(s)), ","))))
    return F.concat(F.array(root(tree)), let(sections(tree), parts))


def likeness(one: Column, other: Column) -> Column:
    """1 for equal roots, else the Jaccard likeness of the sets of nodes: less than 1, as the roots differ.

    A section that differs in one leaf, or in the order of its leaves, has another digest than before.
    """

    def compared(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return both / (F.size(F.array_distinct(x["a"])) + F.size(F.array_distinct(x["b"])) - both)

    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(let(F.struct(nodes(one).alias("a"), nodes(other).alias("b")), compared))


def edits(one: Column, other: Column) -> Column:
    """Where two trees differ: array of (section, leaf) places in the second, from 0.

    Sections whose digests also stand in the first are skipped whole; of others those leaves are
    listed that the first doesn't have. Equal roots give an empty array.
    """
    none = F.array().cast("array<struct<section:int,leaf:int>>")

    def found(x: Column) -> Column:
        def inside(s: Column, i: Column) -> Column:
            own = F.split(F.substring(s, DIGITS + 2, F.length(s)), ",")
            new = F.filter(F.transform(own, lambda d, j: F.struct(i.alias("section"), j.alias("leaf"), d.alias("d"))), lambda d: ~F.array_contains(x["leaves"], d["d"]))
            return F.when(F.array_contains(x["heads"], F.substring(s, 1, DIGITS)), none).otherwise(F.transform(new, lambda d: F.struct(d["section"], d["leaf"])))

        return F.flatten(F.transform(x["b"], inside))

    parts = F.struct(leaves(one).alias("leaves"), F.transform(sections(one), lambda s: F.substring(s, 1, DIGITS)).alias("heads"), sections(other).alias("b"))
    return F.when(root(one) == root(other), none).otherwise(let(parts, found))


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text) of every row, the last by doc_id followed by the first.

    Rows are dealt by ranges of ids, whose limits come from approximate quantiles: as many as
    shuffle partitions times a constant, so a range holds no more than one partition would. Limits
    are ids of the table, so each is the first of its range, and that row also goes to the range
    before it. Rows that share an id follow each other by text. A row without an id has no place in
    the order and is its own next.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    marks = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx("doc_id", marks, RANGE_ACCURACY).alias("q"), F.min("doc_id").alias("low")).first()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    alone = texts.filter("doc_id IS NULL").select("doc_id", "text", F.col("text").alias("next_text"))
    if found.low is None:
        return alone
    starts = sorted({found.low, *found.q})
    constants = lambda ids: F.expr(f"cast(split('{','.join(map(str, ids))}', ',') as array<long>)")
    # the last start that isn't above an id: first among every n-th, then among the n that follow
    step = math.isqrt(len(starts)) + 1
    runs = F.size(F.filter(constants(starts[::step]), lambda x: x <= F.col("doc_id"))) - 1
    near = F.slice(constants(starts), runs * step + 1, F.lit(step))
    own = runs * step + F.size(F.filter(near, lambda x: x <= F.col("doc_id"))) - 1
    before = F.pmod(own - 1, F.lit(len(starts)))
    places = F.when(F.array_contains(near, F.col("doc_id")), F.array(F.struct(own.alias("part"), F.lit(False).alias("guest")), F.struct(before.alias("part"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(own.alias("part"), F.lit(False).alias("guest"))))
    dealt = texts.filter("doc_id IS NOT NULL").withColumn("place", F.explode(places)).select("place.part", "place.guest", "doc_id", "text")
    within = Window.partitionBy("part").orderBy("guest", "doc_id", "text")
    ordered = dealt.withColumn("next_text", F.lead("text").over(within)).filter("NOT guest")
    return ordered.select("doc_id", "text", "next_text").union(alone)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next document. Takes doc_id and text (null: empty), ignores other columns, and returns for
    each row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next and the number of edited leaves. Rows with equal ids follow each other in the order of
    their texts; a lone row is its own next, as is one without an id; an empty table gives an empty
    table. Texts are whole, of any length; the search for edited leaves takes time by the product of
    both texts' leaves.
    """
    rows = followed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    trees = made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return trees.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.size(edits(F.col("fingerprint"), F.col("edited_fingerprint"))).cast("long").alias("edited_leaves"),
    )
