"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .lang_id import fit_profiles, identify, learnable
from .merkle import document_fingerprints
from .ngram_join import ngram_components
from .norm_search import top_products
from .ogg import ogg_media
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .quality import judge
from .secrets import secret_report, train
from .suffix_tree import score_texts
from .vector_codes import vector_codes
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens, see ``pack_documents``."""
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived as WARC records and read back, see ``archive_pages``."""
    found = archive_pages(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose crc32 isn't divisible by 10, see ``score_texts``. A null id is neither learned from nor held out."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    scored = score_texts(docs, docs.filter(~held_out), F.coalesce(~held_out, F.lit(False)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as Ogg media and read back, see ``ogg_media``."""
    return ogg_media(_table(spark, sf_dir, "documents"), keep=False)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the components of their near copies, see ``ngram_components``."""
    return ngram_components(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the spans of their secrets, see ``find_secrets``; the models learn from all documents."""
    docs = _table(spark, sf_dir, "documents")
    return secret_report(docs, train(docs))


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprints of their texts and edited texts, see ``document_fingerprints``."""
    return document_fingerprints(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with predicted languages, see ``identify``. A null id is neither learned from nor held out."""
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, fit_profiles(learnable(docs)))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by text and site, see ``judge``."""
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, see ``encode_decode``."""
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them made to repeat, with their runs, see ``periodic_runs``."""
    return periodic_runs(_table(spark, sf_dir, "documents"), keep=False)


def op12_norm_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest products of every 50th vector with all others, see ``top_products``."""
    vectors = _table(spark, sf_dir, "embeddings")
    return top_products(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5, 256)


def op13_va_file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors coded by codebooks fitted on all of them, see ``vector_codes``."""
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_warc, op3_suffix_tree_scores, op4_ogg_media, op5_ngram_jaccard_join, op6_secrets, op7_merkle_fingerprints, op8_language_id, op9_quality, op10_bpe, op11_periodic_runs, op12_norm_bucket_search, op13_va_file_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op7_merkle_fingerprints": MERKLE_SQL, "op12_norm_bucket_search": SEARCH_SQL, "op13_va_file_codes": codes_sql()}


#: Base32 of a digest: of each 5 hex digits 4 letters.
WARC_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, n, min(page_id) AS first FROM d GROUP BY x, n)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN m USING (x, n)
"""

#: Lines and sentences are cut at marks put after their ends.
MERKLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), (SELECT arg_min(t, doc_id) FROM d)) AS nx FROM d),
e AS (SELECT doc_id, t, nx, left(t, length(t) - length(t) // 2) || left(nx, length(t) // 2) AS ed FROM n),
k AS (SELECT doc_id, 'a' AS kind, t AS s FROM e UNION ALL SELECT doc_id, 'b', ed FROM e UNION ALL SELECT doc_id, 'c', nx FROM e),
l AS (SELECT doc_id, kind, list_transform(string_split(replace(s, chr(10), chr(10) || chr(2)), chr(2)),
    lambda x: list_transform(string_split(regexp_replace(x, '([.!?] )', '\1' || chr(1), 'g'), chr(1)), lambda y: sha256(y))) AS q FROM k),
t AS (SELECT doc_id, kind, list_transform(q, lambda x: {'d': sha256(array_to_string(x, ',')), 'l': list_transform(x, lambda z: z[1:12])}) AS q FROM l),
f AS (SELECT doc_id, kind, q, sha256(array_to_string(list_transform(q, lambda x: x.d), ',')) AS root,
    array_to_string(list_transform(q, lambda x: x.d[1:12] || ':' || array_to_string(x.l, ',')), '|') AS body,
    list_distinct(flatten(list_transform(q, lambda x: x.l))) AS leaves,
    list_distinct(list_concat(flatten(list_transform(q, lambda x: x.l)), list_transform(q, lambda x: x.d[1:12]), [sha256(array_to_string(list_transform(q, lambda x: x.d), ','))])) AS nodes FROM t),
p AS (SELECT a.doc_id, a.root || '|' || a.body AS fingerprint, b.root || '|' || b.body AS edited_fingerprint,
    CASE WHEN a.root = b.root THEN 1.0 ELSE len(list_intersect(a.nodes, b.nodes)) / (len(a.nodes) + len(b.nodes) - len(list_intersect(a.nodes, b.nodes))) END AS near_edited,
    CASE WHEN a.root = c.root THEN 1.0 ELSE len(list_intersect(a.nodes, c.nodes)) / (len(a.nodes) + len(c.nodes) - len(list_intersect(a.nodes, c.nodes))) END AS near_next,
    len(flatten(list_transform(list_filter(b.q, lambda x: NOT list_contains(list_transform(a.q, lambda z: z.d[1:12]), x.d[1:12])), lambda x: list_filter(x.l, lambda y: NOT list_contains(a.leaves, y))))) AS edited_leaves
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.kind = 'b' JOIN f c ON a.doc_id = c.doc_id AND c.kind = 'c' WHERE a.kind = 'a')
SELECT doc_id, length(t) AS n_chars, sha256(ed) AS edited_sha256, fingerprint, edited_fingerprint,
  CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next, edited_leaves
FROM e JOIN p USING (doc_id)
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

SEARCH_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def codes_sql() -> str:
    """SQL of the codes: every round compares all parts with all entries."""
    nearest = "SELECT vec_id, k, y, min({{'d': list_sum(list_transform(list_zip(y, z), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'e': e}}) AS b FROM p JOIN c{0} USING (k) GROUP BY vec_id, k, y"
    mean = """SELECT k, e, coalesce(m, z) AS z FROM c{0} LEFT JOIN (SELECT k, e, list(m ORDER BY i) AS m FROM
  (SELECT k, b.e AS e, i, floor(sum(y[i]) / count(*)) AS m FROM a{0}, unnest(range(1, len(y) + 1)) AS u(i) GROUP BY k, b.e, i) GROUP BY k, e) USING (k, e)"""
    rounds = "".join(f",\na{r} AS MATERIALIZED ({nearest.format(r)}),\nc{r + 1} AS MATERIALIZED ({mean.format(r)})" for r in range(4))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_FINITE}),
p AS MATERIALIZED (SELECT vec_id, k, x[k * len(x) // 4 + 1 : (k + 1) * len(x) // 4] AS y FROM v, range(4) AS u(k)),
c0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, y AS z FROM p QUALIFY e < 256){rounds},
a4 AS MATERIALIZED ({nearest.format(4)}),
r AS (SELECT vec_id, string_agg(printf('%02x', b.e), '' ORDER BY k) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(z, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""
