"""Every query gives the same values as its SQL."""

import pytest
from check_oracle import compare

from __spark_entry__ import entry, oracle_sql, queries


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, db, folder, name):
    assert compare(spark, db, folder, name) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).limit(1).count() == 1
