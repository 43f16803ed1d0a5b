"""Rows of a query and of its SQL, in one comparable form."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def same_rows(df, con, sql):
    result = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(result.columns)
    places = [list(result.columns).index(n) for n in names]
    want = sorted(repr([plain(r[p]) for p in places]) for r in result.fetchall())
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert got == want


SMALL = "/root/testdata/sf0.001"
present = os.path.isdir(SMALL)
