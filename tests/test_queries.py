"""Every registered query of the core: against its SQL, or at least to its end, on the smallest tables."""

import os

import pytest

from stavelake.queries import oracle_sql, queries
from stavelake.session import ship
from tests.sqlcheck import expected, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = queries()[name](ship(spark), SF).toArrow()
    sql = oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert rows(got) == expected(SF, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
