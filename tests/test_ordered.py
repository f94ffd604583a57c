"""Ordered work against brute force, with a group that holds most rows."""

import random

import pytest

from plumbline.operators import ordered as O


def _rows(n=4000, seed=3):
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", rng.random(), i, rng.randrange(9))
        for i in range(n)
    ]


def _groups(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def _df(spark, rows):
    return spark.createDataFrame(rows, "g STRING, o DOUBLE, id INT, v INT")


def test_running_total_and_row_numbers(spark):
    rows = _rows()
    expected_sum, expected_number = {}, {}
    for members in _groups(rows).values():
        total = 0
        for position, row in enumerate(members, 1):
            total += row[3]
            expected_sum[row[2]], expected_number[row[2]] = total, position
    df = _df(spark, rows)
    got = O.running_total(df, ["g"], ["o", "id"], "v", "t").collect()
    assert {r["id"]: r["t"] for r in got} == expected_sum
    got = O.row_numbers(df, ["g"], ["o", "id"], "n").collect()
    assert {r["id"]: r["n"] for r in got} == expected_number


def test_previous_values_keep_nulls(spark):
    rows = [(g, o, i, None if v == 0 else v) for g, o, i, v in _rows()]
    expected = {}
    for members in _groups(rows).values():
        for before, row in zip([None, *members], members):
            expected[row[2]] = before[3] if before else None
    got = O.previous_values(_df(spark, rows), ["g"], ["o", "id"], "v", "p").collect()
    assert {r["id"]: r["p"] for r in got} == expected


def test_carry_forward(spark):
    rows = [(g, o, i, None if i % 5 else v) for g, o, i, v in _rows()]
    expected = {}
    for members in _groups(rows).values():
        current = None
        for row in members:
            current = current if row[3] is None else row[3]
            expected[row[2]] = current
    got = O.carry_forward(_df(spark, rows), ["g"], ["o", "id"], ["v"]).collect()
    assert {r["id"]: r["v"] for r in got} == expected


def test_hot_group_is_spread(spark):
    pieces = O.pin_pieces(_df(spark, _rows()), ["g"], ["o", "id"])
    counts = [r["count"] for r in pieces.filter("g = 'hot'").groupBy(O.PIECE).count().collect()]
    assert len(counts) > 3 and max(counts) < 1500


@pytest.mark.parametrize("threshold", ["1000", "3"])
def test_first_rows(spark, threshold):
    rows = _rows()
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    got = O.first_rows(_df(spark, rows), ["g"], ["o", "id"], 7).collect()
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    expected = {
        (m[2], i) for members in _groups(rows).values() for i, m in enumerate(members[:7], 1)
    }
    assert {(r["id"], r["_rank"]) for r in got} == expected


def test_rows_without_group_stay(spark):
    rows = [(None, 1, 10), (None, 2, 20), ("a", 1, 5)]
    df = spark.createDataFrame(rows, "g STRING, o INT, v INT")
    total = O.running_total(df, ["g"], ["o"], "v", "t")
    assert {(r["g"], r["o"]): r["t"] for r in total.collect()} == {(None, 1): 10, (None, 2): 30, ("a", 1): 5}
    before = O.previous_values(df, ["g"], ["o"], "v", "p")
    assert {(r["g"], r["o"]): r["p"] for r in before.collect()} == {(None, 1): None, (None, 2): 10, ("a", 1): None}
