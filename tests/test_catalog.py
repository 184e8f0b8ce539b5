"""Every query with SQL gives the SQL's rows; every other one runs."""

import pytest

from corpusmix.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(name, agree):
    agree(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).columns


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
