"""Every registered query against DuckDB."""

import pytest

from visitlens.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, same_as_oracle):
    same_as_oracle(plans.QUERIES[name], plans.SQL[name])


def test_all_have_sql():
    assert set(plans.QUERIES) == set(plans.SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
