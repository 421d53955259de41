"""Holds a query's rows against its SQL in DuckDB, without order, numbers to six digits."""

import decimal
import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, int, float, decimal.Decimal)):
        return f"{float(v):.6g}" if abs(v) < 1e6 or not isinstance(v, int) else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(plain(r[c]) for c in names) for r in table.to_pylist())


def expected(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return rows(con.sql(sql).to_arrow_table())
