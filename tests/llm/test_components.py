"""Connected components end with stars or with an error."""

import pytest

from trainframe.llm import common


def test_a_bound_that_is_hit_raises(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        common.connected_components(edges, most_rounds=1)
    assert {tuple(r) for r in common.connected_components(edges).collect()} == {(k, 0) for k in range(41)}
