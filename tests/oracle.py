"""Runs a query and its SQL on the same tables and compares all rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def compare(df, sql, con):
    got = df.collect()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    a = Counter(tuple(plain(r[c]) for c in order) for r in got)
    b = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want)
    assert a == b, (len(got), len(want), list((a - b).items())[:3], list((b - a).items())[:3])
    return len(got)
