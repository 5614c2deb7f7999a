"""Every query against its SQL."""

import pytest

from mycelia.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1576
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
