"""Compares a query with its SQL on DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "int32", "float64"):
        f = float(v)
        return round(f, 5) + 0.0 if math.isfinite(f) else f
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def check(spark, con, query, sql, sf):
    df = query(spark, sf)
    theirs = con.sql(sql)
    assert sorted(df.columns) == sorted(theirs.columns)
    mine, other = rows(df.columns, df.collect()), rows(theirs.columns, theirs.fetchall())
    assert len(mine) == len(other)
    assert mine == other
