"""Rows of a Spark query against those of its SQL."""

import os
from collections import Counter

import duckdb


def tables(d):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    return c


def plain(row):
    return tuple("~" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


def compare(df, sql, con):
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(plain([row[i] for i in at]) for row in r.fetchall())
    got = Counter(plain(row) for row in df.select(*cols).collect())
    assert got == want
