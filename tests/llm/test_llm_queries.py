"""Every query of the package runs over the smallest tables and agrees with its SQL where it has some."""

import pytest

import __spark_entry__ as entry
from compare import compare
from tideline.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    _, _, _, diff = compare(spark, small, name, queries.QUERIES[name], queries.SQL.get(name))
    assert not diff


def test_entry_has_them():
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.SQL) <= set(entry.oracle_sql())
