import pytest

from strataweave.operators import graph
from strataweave.plans import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_oracle(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", ["gc_mark_set", "gc_run"])
def test_marks_are_whole_beyond_the_limits_of_a_process(spark, monkeypatch, name):
    monkeypatch.setattr(graph.mark, "__defaults__", (0, 5, 5))
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
