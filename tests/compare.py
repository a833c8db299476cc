"""Rows of a query against those of its SQL."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def same_rows(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names, (sorted(cols), names)
    at = [cols.index(c) for c in names]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, (len(bad), len(got), bad[:3])
    return len(got)
