"""Comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        path = f"{root}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr([row[n] for n in names]) for row in df.collect())


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([row[i] for i in order]) for row in done.fetchall())
