"""From raw documents to packed sequences: a chain of corpus operators.

A stage takes ``documents`` (doc_id, text, lang, source, n_chars; more columns, whatever their
names, stay until packing). Nulls may stand in any column. What becomes of odd rows:

* null, empty or blank text: judged by its site alone, then dropped by ``language``, as it has no letter;
* very long text: handled whole; null doc_id: kept by ``near_copies``, otherwise like any row;
* repeated rows: judged alike, all kept or all dropped; ``near_copies`` keeps rows that share the smallest id;
* ties: a posterior of one half is bad, a tie of languages goes to the first name, of copies the smallest id stays;
* empty table: an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from latticeframe.llm.lang_id import fit_profiles, kept_languages, learnable
from latticeframe.llm.ngram_join import without_near_copies
from latticeframe.llm.packing import pack_documents
from latticeframe.llm.quality import kept_documents
from latticeframe.llm.secrets import train, without_secrets
from latticeframe.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely bad than good, by text and site."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages learned from what is left."""
    return kept_languages(docs, fit_profiles(learnable(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id."""
    return without_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts; ``n_chars`` counts what is left."""
    return without_secrets(docs, train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of documents into sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list = [("quality", quality), ("language", language), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]
#: Learned models and packing can't be said in SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
