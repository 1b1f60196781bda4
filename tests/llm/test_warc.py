import base64
import hashlib
import tempfile

import pytest
from latticeframe.llm.warc import archive_pages, checked_payloads, describe, parse_record, read_records, record_head, write_archive
from pyspark.sql import functions as F

PAGES = [
    (5, "http://a/x", "<p>ü😀</p>"),
    (3, "http://a/y", "<p>ü😀</p>"),
    (9, "http://b/", "<p>ü😀</p>"),
    (4, None, None),
    (2, "http://c/\r\nX: y", ""),
    (7, "http://d/", "\r\n\r\nWARC/1.1\r\n\r\n" * 3),
    (8, "http://e/", "x" * 300_000),
    (None, "http://f/", "x" * 300_000),
    (None, "http://f/", "alone"),
    (11, "http://g/", "again"),
    (11, "http://g/", "again"),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "other", b"1") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload binary").repartition(3)


def brute_force(least):
    out = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == raw]
        first = min((p for p in same if p is not None), default=None)
        own = len(raw) < least or page == first
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 100])
def test_records_equal_brute_force(pages, least):
    got = archive_pages(pages, least_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute_force(least)


def test_exact_round_trip(spark, pages):
    folder = tempfile.mkdtemp(prefix="spark-") + "/archive"
    write_archive(pages, folder)
    stored = checked_payloads(spark, folder)
    assert stored.count() == stored.select("digest").distinct().count() == len({h or "" for _, _, h in PAGES})
    heads = {(r.page_id, r.digest, r.revisit): (bytes(r.head), bytes(r.tail)) for r in spark.read.parquet(f"{folder}/heads").collect()}
    payloads = {r.digest: bytes(r.payload) for r in stored.collect()}
    for r in read_records(spark, folder).collect():
        fields, _, payload = parse_record(bytes(r.record))
        revisit = fields["WARC-Type"] == "revisit"
        head, tail = heads[r.page_id, r.digest, revisit]
        assert bytes(r.record) == head + (b"" if revisit else payloads[r.digest]) + tail
        assert payload == (b"" if revisit else payloads[r.digest])


def test_damage_is_found(spark, pages):
    folder = tempfile.mkdtemp(prefix="spark-") + "/archive"
    write_archive(pages, folder)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).collect()
    spark.createDataFrame(bad, spark.read.parquet(f"{folder}/payloads").schema).write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        describe(read_records(spark, folder)).collect()
    with pytest.raises(ValueError):
        parse_record(record_head(1, "u", 3, "00" * 20, None) + b"four\r\n\r\n")


def test_empty_table(pages):
    assert archive_pages(pages.limit(0)).count() == 0
