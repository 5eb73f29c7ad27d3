"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares rows in any order."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        at = f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}/*.parquet'" if os.path.isdir(at) else f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{at}'")
    return con


def _plain(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([_plain(x) for x in v])
    return str(v)


def compare(spark, con, build, sql):
    df = build(spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    other = [d[0] for d in cur.description]
    assert sorted(other) == names
    at = [other.index(n) for n in names]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
