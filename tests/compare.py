"""Side-by-side comparison with DuckDB, as the driver does it."""

import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def same(df, connection, sql):
    columns = sorted(df.columns)
    relation = connection.sql(sql)
    assert sorted(relation.columns) == columns
    ours = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    theirs = sorted(map(repr, connection.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))
    assert ours == theirs
    return len(ours)
