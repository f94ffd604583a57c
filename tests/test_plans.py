"""Plans: pushed filters, single scans, no Python work, no cross join."""

import re

import pytest

import __spark_entry__ as contract
from plumbline.plans import registry

KEYS = sorted(registry.QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [k for k in KEYS if k not in ("query_batch", "lessons_stream")])
def test_plan_has_no_python_and_no_cross_join(spark, sf_dir, key):
    plan = plan_of(contract.queries()[key](spark, sf_dir))
    for word in ("Python", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def _plan(spark, sf_dir, key):
    return plan_of(contract.queries()[key](spark, sf_dir))


def test_time_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for key in ("shard_union_counts", "active_users_distinct", "users_lapsed", "coded_date_range"):
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual", _plan(spark, sf_dir, key)), key
    spark.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.mark.parametrize(
    "key, scans",
    [
        ("filtered_minmax_share", 1),
        ("json_keys_distinct", 1),
        ("user_set_counts", 2),
        ("users_intersect", 1),
        ("users_lapsed", 1),
        ("fee_by_correlated_avg", 2),
        ("predicate_survival", 2),
        ("predicate_removals", 2),
    ],
)
def test_scans(spark, sf_dir, key, scans):
    assert _plan(spark, sf_dir, key).count("FileScan parquet") == scans


def test_account_totals_are_made_once(spark, sf_dir):
    df = contract.queries()["net_balance_topk_avg"](spark, sf_dir)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan parquet") == 3


def test_only_needed_columns_are_read(spark, sf_dir):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", _plan(spark, sf_dir, "max_of_sum")).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_quantity", "l_suppkey"]


def test_row_wise_queries_do_not_shuffle(spark, sf_dir):
    keys = ["sql_clean", "recon_guard_limit", "timeout_estimate", "classify_errors", "subtask_tree_text",
            "flatten_params", "range_and_distance"]
    for key in keys:
        assert "Exchange" not in _plan(spark, sf_dir, key), key


def test_small_aggregate_is_broadcast_without_shuffling_rows(spark, sf_dir):
    plan = _plan(spark, sf_dir, "partition_avg")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
