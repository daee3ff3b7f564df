"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    names, expected = rows_of(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    found = sorted((tuple(r[c] for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in expected), key=key)
    assert found == want
