"""Queries of the subpackage that SQL can express, against their oracles."""

import pytest

from oracle import differences
from plumbline.llm import queries


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, sf_dir, key):
    assert not differences(queries.QUERIES[key](spark, sf_dir), sf_dir, queries.ORACLES[key])


@pytest.mark.parametrize("key", ["op4_url_filters", "op5_benchmark_decontamination"])
def test_native_plans_run_no_python(spark, sf_dir, key):
    df = queries.QUERIES[key](spark, sf_dir)
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
