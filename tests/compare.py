"""Compares a query with its DuckDB SQL on the same files, as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def same(df, sql: str, sf_dir: str) -> None:
    cols, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cols2, rows2 = rows_of(*duck(sql, sf_dir))
    assert cols == cols2, (cols, cols2)
    only, only2 = rows - rows2, rows2 - rows
    assert not only and not only2, f"{sum(rows.values())} and {sum(rows2.values())} rows; only Spark {list(only)[:3]}, only SQL {list(only2)[:3]}"
