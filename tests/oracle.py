"""Runs a query and its SQL side by side."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def plain(v) -> str:
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v) + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def connection(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def both(spark, con, sf: str, query, sql: str):
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return ours, sorted(tuple(plain(r[k]) for k in at) for r in result.fetchall())
