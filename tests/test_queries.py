"""Every query beside its independent SQL."""

import pytest
from oracle_check import differences

from condspark.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_same_as_sql(spark, name):
    assert differences(spark, q.QUERIES[name], q.ORACLE[name]) == ""


def test_flagship_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
