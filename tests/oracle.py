"""Comparing a query's rows with those of SQL in DuckDB, whatever their order."""

import glob
import os

import duckdb


def _plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, dict):
        return tuple(_plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(sql, folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    names = found.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def agree(df, sql, folder):
    a, b = rows_of(df), sql_rows(sql, folder)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
