"""Runs a query on Spark and its oracle on DuckDB, and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=key)


def difference(df, con, sql) -> str:
    """Empty if the results are the same."""
    (a, x), (b, y) = spark_rows(df), duck_rows(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; first {x[:2]} and {y[:2]}"
    if bad := [(p, q) for p, q in zip(x, y) if p != q]:
        return f"{len(bad)} of {len(x)} rows differ, first {bad[0]}"
    return ""
