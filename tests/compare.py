"""Rows of a query against the rows of its SQL."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as from '{sf}/{t}.parquet'")
    return con


def same(df, sql: str, con) -> tuple[bool, str]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return False, f"columns {df.columns} and {names}"
    want = Counter(map(repr, cur.fetchall()))
    got = Counter(repr(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    return got == want, f"{sum(got.values())} rows and {sum(want.values())}; only here {list((got - want))[:3]}; only there {list((want - got))[:3]}"
