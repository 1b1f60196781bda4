"""WARC archives kept by content: each payload once under its digest, record headers apart.

An archive is a folder of two Parquet tables, so that any store Spark writes to can hold it:

* ``heads`` (page_id, digest, revisit, head, tail): the exact bytes of a record before and after its payload,
* ``payloads`` (digest, sha1, size, first, payload): payload bytes by SHA-256, checked against it before use.

A ``response`` record is head + payload + tail; a ``revisit`` record, for a payload that an
earlier page has too, is head + tail and names the response. Joins on the digest put records
together again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, shared_folder

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
#: The date written into records; archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HEADS = "page_id long, digest string, revisit boolean, head binary, tail binary"


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url}')}>"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_head(page_id: int | None, url: str | None, size: int, sha1: str, first: tuple[int | None, str | None] | None) -> bytes:
    """What stands before the payload; ``first`` is the page whose record a revisit refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if first:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*first)), ("X-Refers-To-Page-ID", str(first[0]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + (0 if first else size)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""]) + http


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's fields, its HTTP headers, and what follows them. Raises ValueError if lengths don't fit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if version != VERSION or rest[size:] != RECORD_END:
        raise ValueError(f"not a whole WARC record: {fields.get('WARC-Record-ID')}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html), the html in UTF-8 (null: empty) as payload.

    Of rows with equal payloads of at least ``least_bytes`` bytes those with the smallest page_id
    are responses and others revisits; shorter ones are all responses. Payloads are equal if
    SHA-256, SHA-1 and length are. Rows that share the smallest page_id are all responses; a null
    page_id counts as the largest. Grouping by digest keeps one payload for each digest and task
    before the shuffle, so a payload that very many pages share moves once for each task.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = [F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).select("page_id", "url", *digests, "payload")
    order = F.struct(F.col("page_id").isNull(), "page_id", F.coalesce("url", F.lit("")))
    stored = rows.groupBy("digest", "sha1", "size").agg(F.min_by(F.struct("page_id", "url"), order).alias("first"), F.any_value("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = r["size"] < least_bytes or r["page_id"] == r["first"]["page_id"]
                source = None if own else (r["first"]["page_id"], r["first"]["url"])
                out.append((r["page_id"], r["digest"], not own, record_head(r["page_id"], r["url"], r["size"], r["sha1"], source), RECORD_END))
            kinds = pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "digest", "revisit", "head", "tail"])

    firsts = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "first")
    named = rows.select("page_id", "url", "digest", "sha1", "size").join(firsts, "digest")
    named.select("page_id", "url", "digest", "sha1", "size", "first").mapInArrow(bounded(heads), HEADS).write.parquet(f"{folder}/heads")


def checked_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) of an archive; bytes that don't have their digest raise an error."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest")).cast("binary")
    return stored.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, digest, record): the exact bytes of every record, put together from heads and payloads."""
    heads = spark.read.schema(HEADS).parquet(f"{folder}/heads")
    whole = heads.filter("NOT revisit").join(checked_payloads(spark, folder), "digest").select("page_id", "digest", F.concat("head", "payload", "tail").alias("record"))
    return whole.union(heads.filter("revisit").select("page_id", "digest", F.concat("head", "tail").alias("record")))


def describe(records: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_digest, payload_bytes, refers_to, record_id, url, digest) parsed from the bytes of records.

    A response's digest is computed from its payload and has to be the one it states. Of a revisit
    the length is that in its HTTP headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields, http, payload = parse_record(record)
                stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or base32(hashlib.sha1(payload).hexdigest()) != stated):
                    raise ValueError(f"payload differs from its record: {fields['WARC-Record-ID']}")
                page = fields["X-Page-ID"]
                rows.append((int(page) if page else None, fields["WARC-Type"], stated, size, int(fields["X-Refers-To-Page-ID"]) if revisit else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], digest))
            kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], PARSED)

    kinds = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string, url string, digest string"
    return records.select("digest", "record").mapInArrow(bounded(run), kinds)


PARSED = ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "record_id", "url", "digest"]


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to an archive, by default a new one in the shared folder, and describes its records as read back.

    See ``write_archive`` for ties and nulls. Whole payloads of any length; an empty table makes an
    empty archive. Columns besides page_id, url and html are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, least_bytes)
    return describe(read_records(spark, folder))
