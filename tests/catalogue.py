"""Compares registered queries with their SQL, on the smallest test tables."""

import math
from pathlib import Path

import duckdb

TABLES = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in TABLES.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in (r[i] for i in order)) for r in rows), key=repr)


def compare(spark, con, query, sql):
    df, found = query(spark, str(TABLES)), con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(map(tuple, df.collect()), df.columns) == plain(found.fetchall(), names)
