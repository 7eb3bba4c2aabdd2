"""Compares a query's rows with its SQL on the same tables."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(data=DATA):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        if os.path.exists(f"{data}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def rows(values, columns):
    at = [columns.index(c) for c in sorted(columns)]

    def plain(v):
        if isinstance(v, float):
            return repr(round(v, 9))
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return repr(v)

    return sorted(tuple(plain(r[i]) for i in at) for r in values)


def same(spark, c, query, sql, data=DATA):
    df = query(spark, data)
    want = c.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)
