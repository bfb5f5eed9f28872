"""Comparison of a query's rows with those of its SQL in DuckDB, as multisets, columns by name."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    at = [found.index(c) for c in names]
    want = ordered(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
