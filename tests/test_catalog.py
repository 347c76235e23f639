"""Each registered query against its SQL, over the smallest tables."""

import pytest

from corvane.plans import catalog
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.collect() is not None
    else:
        assert not differences(df, sql, FOLDER)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "together", "share_of_a", "share_of_b"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
