"""Every query runs, and equals its SQL where it has one."""

import pytest
from oracle import assert_same

from folioscope import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    found = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert_same(found, sql, sf_dir)
    else:
        assert len(found.columns) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
