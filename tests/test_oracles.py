"""Every registered query against its oracle SQL."""

import pytest

import __spark_entry__ as contract
from oracle import differences
from plumbline.plans import registry

KEYS = sorted(registry.QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_dir, key):
    df = contract.queries()[key](spark, sf_dir)
    sql = contract.oracle_sql().get(key)
    assert sql, "every query has an oracle"
    assert not differences(df, sf_dir, sql)


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "total" and df.count() == 1
