"""Every query against the SQL that states its result."""

import pytest

import __spark_entry__ as entry
from docflow.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, same_rows, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_rows(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
