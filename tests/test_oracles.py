"""Every query with SQL gives the rows of its SQL; queries that read other tables are tested with their subpackage."""

import pytest
from duck import check

from roadprep.jobs.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    check(spark, name, queries()[name], oracle_sql()[name], SF)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
