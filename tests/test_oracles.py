"""Each registered query of the core against its SQL on the smallest tables."""

import pytest
from conftest import SMALL, rows_of

from siftwell import bindings


@pytest.mark.parametrize("name", sorted(bindings.QUERIES))
def test_query(spark, duck, name):
    got = bindings.QUERIES[name](spark, SMALL).toPandas()
    if name not in bindings.ORACLE_SQL:
        assert len(got) > 0
        return
    assert rows_of(got) == rows_of(duck.sql(bindings.ORACLE_SQL[name]).df())


def test_entry():
    import __spark_entry__ as entry

    assert set(bindings.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
