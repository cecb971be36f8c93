"""Run registered queries next to their SQL and compare rows, columns and values."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, con, fn, sql: str, folder: str) -> tuple[str | None, int, float, float]:
    """First difference (or None), rows, and seconds of both sides."""
    t0 = time.time()
    df = fn(spark, folder)
    got = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    want = cur.fetchall()
    t2 = time.time()
    names, expected = df.columns, [d[0] for d in cur.description]
    timing = (len(got), round(t1 - t0, 2), round(t2 - t1, 2))
    if sorted(names) != sorted(expected):
        return f"columns {sorted(names)} != {sorted(expected)}", *timing
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", *timing
    a, b = rows_of(names, got), rows_of(expected, want)
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(names)}\n   spark {x}\n   sql   {y}", *timing
    return None, *timing
