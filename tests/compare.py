"""Comparing a Spark query with its SQL in DuckDB: columns by name, rows as a multiset."""

import os
from collections import Counter

import duckdb

ROOT = "/root/testdata/sf0.001"


def database(root=ROOT):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(root):
        at = os.path.join(root, f)
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, sql, db):
    cols = sorted(df.columns)
    got = Counter(plain(tuple(r)) for r in df.select(*cols).collect())
    found = db.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    want = Counter(plain(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    assert got == want, f"only here {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
