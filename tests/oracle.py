"""Compare a registered query with its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def same(spark, folder, query, sql):
    df = query(spark, folder)
    con = connect(folder)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, rel.fetchall())
    assert got == want, (got[:3], want[:3], len(got), len(want))
