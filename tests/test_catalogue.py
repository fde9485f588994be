"""Every query of the catalogue gives the rows of its SQL."""

import pytest

from loamtext.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows_equal_the_sql(name, compare, small):
    compare(name, small)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
