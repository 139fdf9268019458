import pytest

from hubbub.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
