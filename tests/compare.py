"""Spark rows against DuckDB rows."""
from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


def both(spark, sf: str, query, sql: str) -> tuple[list, list, list, list]:
    df = query(spark, sf)
    cur = connect(sf).execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(df.columns), sorted(names), rows(df.columns, df.collect()), rows(names, cur.fetchall())
