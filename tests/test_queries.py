"""Every core query runs over the smallest tables and agrees with its SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare
from tideline.plans import account, checks, copying, relational, selecting, simulating, stored, upkeep, verifying

MODULES = (upkeep, relational, account, copying, checks, stored, selecting, simulating, verifying)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, small, module, name):
    rows, want, _, diff = compare(spark, small, name, module.QUERIES[name], module.SQL.get(name))
    assert not diff
    assert rows >= 0


def test_entry(spark, small):
    assert entry.entry(spark).limit(1).count() == 1
    assert {n for _, n in NAMES} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
