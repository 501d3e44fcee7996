"""Results of a query and of its SQL in DuckDB, as sorted rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "~null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def both(spark, sf_dir: str, query, sql: str):
    """Sorted column names and rows of either engine."""
    df = query(spark, sf_dir)
    rel = connect(sf_dir).execute(sql)
    names = [d[0] for d in rel.description]
    return (sorted(df.columns), rows_of(df.columns, df.collect())), (sorted(names), rows_of(names, rel.fetchall()))
