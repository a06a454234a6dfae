"""Rows of a query and of its SQL, in one comparable form."""

import glob
import os
from decimal import Decimal

import duckdb


def _plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, bytes):
        return v.hex()
    return str(v)


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
