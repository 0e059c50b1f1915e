"""Spark and DuckDB results side by side."""

from pathlib import Path

import duckdb

TABLES = ["region", "nation", "events", "documents", "pages", "benchmark", "labels"]


def duck(folder):
    connection = duckdb.connect()
    connection.sql("set timezone = 'UTC'")
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.sql(f"create view {name} as select * from '{path}'")
    return connection


def rows(columns, values):
    """Rows as tuples in column-name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    found = connection.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())
