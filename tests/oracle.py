"""Compares a query with its SQL on the same tables."""

import glob
import os
from collections import Counter

import duckdb


def _plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def compare(spark, folder, name, query, sql):
    got = query(spark, folder)
    columns = sorted(got.columns)
    mine = Counter(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == columns, name
    at = [names.index(c) for c in columns]
    theirs = Counter(tuple(_plain(r[i]) for i in at) for r in con.fetchall())
    assert mine == theirs, (name, list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
