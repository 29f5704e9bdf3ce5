import pytest
from oracle import same

from tagfold.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, sf, name):
    same(spark, name, sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
