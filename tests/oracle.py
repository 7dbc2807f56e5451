"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares columns, rows and values."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else (int(x) if x == int(x) and abs(x) < 1e15 else round(x, 9))
    return [plain(v) for v in x] if isinstance(x, list) else x


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr([plain(v[i]) for i in order]) for v in values)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    got = spark_df.collect()
    rel = con.sql(sql)
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(rel.columns)}"
    a, b = rows(spark_df.columns, [tuple(r) for r in got]), rows(rel.columns, rel.fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only Spark: {list((a - b).items())[:3]}; only SQL: {list((b - a).items())[:3]}"
    return "" if a else "no rows"
