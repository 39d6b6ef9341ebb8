"""Every query of the engine's own operators against its SQL."""

import pytest
from conftest import DATA

from tallyloom import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, same, name):
    same(catalog.queries()[name](spark, DATA), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).columns
    catalog.queries()[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
