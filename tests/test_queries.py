"""Every core query against its SQL twin on the smallest tables."""

import compare
import pytest

from millrace.queries import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, folder, name):
    assert compare.difference(spark, QUERIES[name], ORACLES[name], folder) == ""


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_twin_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
    assert all("\n" not in n and n for n in entry.queries())
