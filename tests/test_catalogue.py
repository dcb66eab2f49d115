import pytest

from textloom.plans import catalogue

from .oracle import same


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], sf)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    assert [f.name for f in e.entry(spark).schema] == ["word", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
