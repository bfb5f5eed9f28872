"""Queries of the subpackage with SQL, and what the entry module registers."""

import os

import oracle
import pytest

from trainframe.llm import entry


@pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="the sample tables are not here")
@pytest.mark.parametrize("name", entry.SQL)
def test_query_equals_sql(spark, name):
    oracle.same(entry.QUERIES[name](spark, oracle.DATA), oracle.database(), entry.SQL[name])


def test_all_are_registered():
    import __spark_entry__ as e

    assert {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in e.queries()
