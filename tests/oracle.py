"""A query's rows against DuckDB's."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def expected(sql, sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = c.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), rows(names, out.fetchall())


def got(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
