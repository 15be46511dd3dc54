"""Every query against its SQL; test_functions has brute force for those without."""

from __future__ import annotations

import pytest
from compare import DATA, assert_same

from quire.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.SQL[name])


def test_queries_without_sql_have_a_test_of_their_own():
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"normalize_table", "table_translate"}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
