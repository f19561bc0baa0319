"""A Spark result against a DuckDB result: names of columns, and rows as a multiset."""

import math
import os
from collections import Counter

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return repr(x + 0.0) if isinstance(x, float) else str(x)


def assert_same(df, con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    want = Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    have = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert have == want, (list((have - want).elements())[:2], list((want - have).elements())[:2])
