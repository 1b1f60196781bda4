"""Runs a query in Spark and its SQL in DuckDB and compares all rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return db


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    return x


def rows(names: list[str], found) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_value(row[k]) for k in order) for row in found), key=repr)


def difference(spark, db: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    own = rows(df.columns, df.collect())
    result = db.execute(sql)
    other = rows([c[0] for c in result.description], result.fetchall())
    if own[0] != other[0]:
        return f"columns {own[0]} and {other[0]}"
    if len(own[1]) != len(other[1]):
        return f"{len(own[1])} and {len(other[1])} rows"
    for x, y in zip(own[1], other[1], strict=True):
        if x != y:
            return f"{x} and {y}"
    return None
