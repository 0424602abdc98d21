"""Every registered query against its SQL on the smallest data folder."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name)) is None


def test_entry_is_lazy_and_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
