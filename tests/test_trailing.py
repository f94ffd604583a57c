"""Trailing windows over masks of days, against counting each window by itself."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.operators import trailing


def brute(rows, ends, lengths):
    return sorted(
        (end, n, len({k for k, t in rows if k is not None and t is not None and 0 <= (end - t.date()).days < n}))
        for end in ends
        for n in lengths
    )


@pytest.mark.parametrize("span", [5, 64, 150])
def test_against_each_window(spark, span):
    rng = random.Random(span)
    start = date(2023, 12, 1)
    moment = lambda: datetime(2023, 11, 20) + timedelta(minutes=rng.randrange(60 * 24 * 200))
    rows = [(rng.choice([None, "hot", "hot", *map(str, range(40))]), moment()) for _ in range(900)]
    rows += [("x", None), ("edge", datetime(2023, 12, 1)), ("edge", datetime(2023, 12, 1, 23, 59, 59, 999999))]
    ends = [start + timedelta(k) for k in range(span)]
    lengths = [7, 2, 1, 90]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, ts timestamp_ntz, key int")
    got = trailing.trailing_distinct(df, F.col("k"), F.col("ts"), ends[0], ends[-1], lengths)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, ends, lengths)


def test_parts_merge(spark):
    first, last = date(2024, 1, 1), date(2024, 3, 31)
    df = spark.range(3000).selectExpr(
        "id % 70 AS k", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 91 AS int)) AS ts", "id"
    )
    mask = lambda rows: trailing.day_masks(rows, F.col("k"), F.col("ts"), first, last)
    parts = [mask(df.where(f"id % 3 = {k}")) for k in range(3)]
    merged = trailing.merged_masks(parts)
    assert sorted(merged.collect()) == sorted(mask(df).collect())


def test_empty_and_cut_windows(spark):
    empty = spark.createDataFrame([], "k bigint, ts timestamp_ntz")
    day = date(2024, 1, 5)
    got = trailing.trailing_distinct(empty, F.col("k"), F.col("ts"), day, day, [3])
    assert [tuple(r) for r in got.collect()] == [(day, 3, 0)]
    with pytest.raises(ValueError):
        trailing.trailing_counts(empty, day, [day], [2])


def test_one_scan(spark, sf_dir):
    from plumbline.plans.analytics import trailing_active_users

    plan = trailing_active_users(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "PushedFilters: [IsNotNull(event_type)" in plan
