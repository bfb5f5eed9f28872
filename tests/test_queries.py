"""Every query of the library against its SQL, and the entry module."""

import os

import oracle
import pytest

from trainframe import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the sample tables are not here")


@pytest.fixture(scope="module")
def con():
    return oracle.database()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, con, name):
    oracle.same(queries.QUERIES[name](spark, oracle.DATA), con, queries.SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["key", "n", "average", "high", "big", "mid", "any_top"]
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql()) <= set(e.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_scan(spark):
    p = plan(queries.filter_rows(spark, oracle.DATA))
    assert "GreaterThan(n_chars,500)" in p and "(lang,en)" in p
    assert "text:" not in p.split("ReadSchema")[1]


#: Python functions, and Arrow files, for which Spark has no reader.
PYTHON = {"python_map", "flat_map", "io_arrow"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - PYTHON - {"stream_filter", "stream_dedupe"}))
def test_no_python_in_plans(spark, name):
    """All but the operators that take a Python function are column expressions."""
    p = plan(queries.QUERIES[name](spark, oracle.DATA))
    assert not any(x in p for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "PythonUDF"))


def test_profile_of_empty_texts(spark, tmp_path):
    """An empty text is no value, but it has a length."""
    rows = [(1, "abc", 3), (2, "", 0), (3, None, None), (4, "é漢", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    oracle.same(queries.QUERIES["stats_profile"](spark, str(tmp_path)), con, queries.SQL["stats_profile"])
