"""Sets of checks to take away, against all subsets tried one by one."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analytics


def brute(rows, partners, names):
    checks = [
        lambda r: r[1] is not None and r[1] > 3,
        lambda r: r[2] == "x",
        lambda r: r[1] is not None and r[1] % 2 == 0,
        lambda r: r[0] in partners and r[0] is not None,
    ]
    found = {}
    for n in range(len(checks) + 1):
        for taken in itertools.combinations(range(len(checks)), n):
            left = [c for k, c in enumerate(checks) if k not in taken]
            count = sum(all(c(r) for c in left) for r in rows)
            if count:
                found[taken] = count
    return {
        (",".join(names[k] for k in taken), len(taken), n, not any(set(o) < set(taken) for o in found))
        for taken, n in found.items()
    }


TESTS = {"high": F.col("a") > 3, "letter": F.col("b") == "x", "even": F.col("a") % 2 == 0}
KIND = "k int, a int, b string, _n int, mask int"


@pytest.mark.parametrize("seed", range(4))
def test_against_all_subsets(spark, seed):
    pick = random.Random(seed)
    # With few rows no row passes all checks, and several sets are minimal.
    rows = [
        (pick.choice([None, 1, 2, 3]), pick.choice([None, *range(8)]), pick.choice([None, "x", "y"]), 1, 2)
        for _ in range((6, 12, 40, 200)[seed])
    ]
    partners = spark.createDataFrame([(1,), (1,), (None,), (3,)], "p int")
    got = analytics.removals(spark.createDataFrame(rows, KIND), TESTS, "k", partners, "p").collect()
    want = brute(rows, {1, 3}, [*TESTS, "join_partner"])
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_empty_and_too_many(spark):
    partners = spark.createDataFrame([], "p int")
    empty = spark.createDataFrame([], KIND)
    assert analytics.removals(empty, TESTS, "k", partners, "p").count() == 0
    with pytest.raises(ValueError):
        analytics.removals(empty, {str(k): F.lit(True) for k in range(12)}, "k", partners, "p")
