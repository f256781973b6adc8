import pytest

from textloom.operators.components import connected_components


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(12)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=1)
    assert {r.component for r in connected_components(path).collect()} == {0}
