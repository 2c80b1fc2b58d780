"""Chains and cycles of more steps than any fixed depth."""

import pytest

from pointweave.operators import graph


def test_closure_of_deep_chains_and_long_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "child long, parent long")
    closed = {(r["node"], r["ancestor"]): r["steps"] for r in graph.closure(chain).collect()}
    assert closed == {(i, j): j - i for i in range(151) for j in range(i + 1, 151)}
    cycle = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)], "child long, parent long")
    assert graph.on_cycles(graph.closure(cycle)).count() == 100
    with pytest.raises(RuntimeError):
        graph.closure(chain, most_rounds=3)
