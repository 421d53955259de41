"""The registered queries that SQL can express, on the smallest tables; all others to their end."""

import os

import pytest

from stavelake.llm.queries import oracle_sql, queries
from stavelake.session import ship
from tests.sqlcheck import expected, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    got = queries()[name](ship(spark), SF).toArrow()
    sql = oracle_sql().get(name)
    if sql is None:
        documents = spark.read.parquet(f"{SF}/documents.parquet").count()
        # op4 gives a row for each leak, all others one for each document
        assert 0 < got.num_rows < documents if name.startswith("op4") else got.num_rows == documents
    else:
        assert rows(got) == expected(SF, sql)
