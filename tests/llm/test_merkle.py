import hashlib

import pytest
from latticeframe.llm.merkle import document_fingerprints, edits, fingerprint, followed, likeness
from pyspark.sql import functions as F

LINES = [f"Line {i} starts here. It has a second sentence! And more {i * i}?" for i in range(40)]
TEXTS = {
    0: "\n".join(LINES),
    1: None,
    2: "",
    5: "one",
    6: "ü😀" * 50 + ". x" * 7,
    7: "\n".join(LINES),
    9: "\n".join(LINES[:20] + ["A new line. With words."] + LINES[21:]),
    11: ("word " * 50 + ".\n") * 2000,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a") for i, t in TEXTS.items()], "doc_id long, text string, fingerprint string").repartition(3)


def test_next_document_and_edited_text_equal_brute_force(docs):
    ids = sorted(TEXTS)
    rows = {r.doc_id: r for r in document_fingerprints(docs).collect()}
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        own, after = TEXTS[i] or "", TEXTS[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = rows[i]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint.split("|")[0] == r.edited_fingerprint.split("|")[0]) == (own == edited)
    assert rows[0].fingerprint == rows[7].fingerprint
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].near_next == 1.0
    assert rows[0].near_edited > 0.4
    assert rows[7].near_next > 0.9


def test_root_is_the_hash_of_the_whole_tree(spark):
    text = "First leaf. Second leaf.\nThird leaf"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = [["First leaf. ", "Second leaf.\n"], ["Third leaf"]]
    heads = [sha(",".join(map(sha, s))) for s in sections]
    want = sha(",".join(heads)) + "".join(f"|{h[:12]}:" + ",".join(sha(x)[:12] for x in s) for h, s in zip(heads, sections, strict=True))
    assert spark.range(1).select(fingerprint(F.lit(text))).first()[0] == want


def test_edits_are_located(docs):
    trees = docs.select("doc_id", fingerprint(F.col("text")).alias("tree"))
    a, b = (trees.filter(F.col("doc_id") == i).select(F.col("tree").alias(n)) for i, n in ((0, "a"), (9, "b")))
    row = a.join(b).select(edits(F.col("a"), F.col("b")), edits(F.col("a"), F.col("a")), likeness(F.col("a"), F.col("b"))).first()
    assert [tuple(x) for x in row[0]] == [(20, 0), (20, 1)] and row[1] == [] and 0.9 < row[2] < 1


def test_likeness_is_1_for_equal_texts_only(spark):
    """Other orders of sentences or lines, and repeats of them, are other trees."""
    texts = ["One. Two. Three", "Two. One. Three", "One. Two. Two. Three", "One. Two.\nThree", "Three\nOne. Two.", "One. Two. Three"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", fingerprint(F.col("t")).alias("f"))
    pairs = rows.join(rows.select(F.col("k").alias("j"), F.col("f").alias("g")), F.col("k") < F.col("j"))
    found = {(r.k, r.j): r.v for r in pairs.select("k", "j", likeness(F.col("f"), F.col("g")).alias("v")).collect()}
    assert len(found) == 15 and all((v == 1.0) == (k == (0, 5)) for k, v in found.items())
    assert found[0, 1] == 3 / 7  # three leaves stay; a section and a root of each are others


def test_null_ids_repeated_rows_and_empty_table(spark, docs):
    rows = spark.createDataFrame([(None, "a. b"), (3, "x"), (3, "y"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.next_text) for r in followed(rows).collect()), key=str)
    assert got == sorted([(None, "a. b", "a. b"), (None, "", ""), (3, "x", "y"), (3, "y", "x")], key=str)
    assert document_fingerprints(rows.limit(0)).count() == 0
    one = document_fingerprints(rows.filter("text = 'x'")).first()
    assert one.near_next == 1.0
    assert document_fingerprints(docs.limit(0)).count() == 0
