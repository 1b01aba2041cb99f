"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else what differs."""
    found = con.sql(sql)
    a = rows_of(df.columns, df.collect())
    b = rows_of(found.columns, found.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    off = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(off)} rows differ, first {off[0]}" if off else None
