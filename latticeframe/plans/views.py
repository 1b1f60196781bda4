"""Arrays made from the sample tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.creation import ordered
from ..tensor import Tensor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, expression: str = "value", extra: str | None = None) -> Tensor:
    """A vector over event_id."""
    df = table(spark, sf_dir, "events").select(F.col("event_id").alias("i0"), F.expr(f"CAST({expression} AS DOUBLE)").alias("v"))
    return Tensor(df, 1)


def lanes(spark: SparkSession, sf_dir: str) -> Tensor:
    """Values of events in order of time, one lane for each user."""
    return ordered(table(spark, sf_dir, "events"), F.col("value"), ["ts", "event_id"], ["user_id"])


def embeddings(spark: SparkSession, sf_dir: str, limit: int | None = None) -> Tensor:
    """A matrix (vec_id x dimension); ``limit`` keeps the first rows, for products of two matrices."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    df = df.select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v"))
    return Tensor(df if limit is None else df.filter(F.col("i0") < limit), 2)


def complex_embeddings(spark: SparkSession, sf_dir: str) -> Tensor:
    """Neighbouring dimensions as real and imaginary parts."""
    t = embeddings(spark, sf_dir)
    pairs = t.df.groupBy("i0", F.floor(F.col("i1") / 2).alias("i1")).agg(
        F.struct(F.max(F.when(F.col("i1") % 2 == 0, F.col("v"))).alias("re"), F.max(F.when(F.col("i1") % 2 == 1, F.col("v"))).alias("im")).alias("v")
    )
    return Tensor(pairs, 2)


def part_names(spark: SparkSession, sf_dir: str) -> Tensor:
    df = table(spark, sf_dir, "part").select((F.col("p_partkey")).alias("i0"), F.col("p_name").alias("v"))
    return Tensor(df, 1)


def sizes(spark: SparkSession, sf_dir: str) -> Tensor:
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i0"), F.col("p_size").cast("double").alias("v"))
    return Tensor(df, 1)


SQL = {
    "lanes": "lanes AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i0, value AS v FROM events)",
    "emb": "emb AS (SELECT vec_id AS i0, CAST(unnest(range(64)) AS BIGINT) AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "names": "names AS (SELECT p_partkey AS i0, p_name AS v FROM part)",
    "sizes": "sizes AS (SELECT p_partkey AS i0, CAST(p_size AS DOUBLE) AS v FROM part)",
    "cplx": "cplx AS (SELECT i0, i1 // 2 AS i1, max(CASE WHEN i1 % 2 = 0 THEN v END) AS re, max(CASE WHEN i1 % 2 = 1 THEN v END) AS im FROM emb GROUP BY i0, i1 // 2)",
}


def with_views(sql: str, *names: str) -> str:
    return f"WITH {', '.join(SQL[n] for n in names)} {sql}" if names else sql
