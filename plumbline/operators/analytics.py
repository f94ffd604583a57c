"""Shapes of analytic questions: flags per key, signed balances, shares, survival checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

# Keys, with one number each, up to which an aggregate is broadcast.
BROADCAST_KEYS = 500_000
MAX_CHECKS = 12  # of which all sets are judged


def flags_per_key(df: DataFrame, key: str, tests: Mapping[str, Column]) -> DataFrame:
    """One row per key with, for each test, whether any row of the key passes it.

    Set questions on the same table (in both sets, in one but not the other) are answered by
    one scan and one pre-aggregated shuffle instead of one scan per set and a join.
    """
    any_test = None
    for test in tests.values():
        any_test = test if any_test is None else any_test | test
    found = {name: F.bool_or(F.coalesce(test, F.lit(False))) for name, test in tests.items()}
    return df.filter(any_test).groupBy(key).agg(*[c.alias(n) for n, c in found.items()])


def in_all(flags: DataFrame, key: str, *names: str) -> DataFrame:
    """Keys in every named set (INTERSECT)."""
    return flags.filter(" AND ".join(names)).select(key)


def in_first_only(flags: DataFrame, key: str, first: str, *others: str) -> DataFrame:
    """Keys of the first set that are in none of the others (set difference)."""
    test = " AND ".join([first, *[f"NOT {o}" for o in others]])
    return flags.filter(test).select(key)


def set_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are in both inputs (``both``) and in the left one alone (``first_only``).

    Each input is scanned once; its keys are pre-aggregated and meet in one shuffle.
    """
    tagged = left.select(key, F.lit(True).alias("in_left")).unionByName(
        right.select(key, F.lit(False).alias("in_left"))
    )
    found = tagged.groupBy(key).agg(
        F.bool_or("in_left").alias("left"), F.bool_or(~F.col("in_left")).alias("right")
    )
    counts = found.agg(
        F.count_if(F.col("left") & F.col("right")).alias("both"),
        F.count_if(F.col("left") & ~F.col("right")).alias("first_only"),
    )
    return counts.unpivot([], ["both", "first_only"], "part", "n_ids")


def share(test: Column) -> Column:
    """Part of the rows that pass; NULL when there are no rows."""
    return F.avg(F.when(test, F.lit(1.0)).otherwise(F.lit(0.0)))


def signed_totals(df: DataFrame, legs: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Sum of signed amounts per account, all legs from one scan.

    ``legs`` maps a leg name to (account, amount). Each row is spread into its legs, and the
    sums are pre-aggregated before the shuffle. Legs without account are left out.
    """
    spread = F.array(
        *[
            F.struct(account.cast("string").alias("account"), amount.alias("amount"))
            for account, amount in legs.values()
        ]
    )
    return (
        df.select(F.inline(spread))
        .filter("account IS NOT NULL")
        .groupBy("account")
        .agg(F.sum("amount").alias("balance"))
    )


def top_mean(df: DataFrame, value: str, count: int, power: int, name: str) -> DataFrame:
    """Mean of the ``count`` largest values in units of 10^power, rounded to 2 digits."""
    top = df.select(value).orderBy(F.col(value).desc()).limit(count)
    return top.agg(F.round(F.avg(value) / F.lit(10.0**power), 2).alias(name))


def mean_per_key(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``AVG(value) OVER (PARTITION BY key)`` as an aggregate joined back to the rows.

    The window would bring all rows of a key into one task. The means are counted: few enough
    of them are broadcast, so the rows are not shuffled at all; more are joined by key, where
    Spark splits heavy keys.
    """
    shared_folder(df.sparkSession)
    means = df.groupBy(F.col(key).alias("_key")).agg(F.avg(value).alias(name)).checkpoint()
    small = F.broadcast(means) if means.count() <= BROADCAST_KEYS else means
    return df.join(small, df[key].eqNullSafe(small["_key"])).drop("_key")


def survival(
    df: DataFrame, tests: Mapping[str, Column], join_key: str, partners: DataFrame, partner_key: str
) -> DataFrame:
    """How many rows pass each filter and join alone, and all of them together.

    One row per check. Rows are counted per join key first, so the join moves one row per key
    however many rows share it.
    """
    together = None
    for test in tests.values():
        together = test if together is None else together & test
    per_key = df.groupBy(F.col(join_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("all_rows"),
        *[F.count_if(t).alias(n) for n, t in tests.items()],
        F.count_if(together).alias("_together"),
    )
    known = partners.select(F.col(partner_key).alias("_partner")).distinct()
    names = ["all_rows", *tests]
    joined = per_key.join(known, F.col("_key") == F.col("_partner"), "left")
    has = F.col("_partner").isNotNull()
    sums = joined.agg(
        *[F.sum(n).alias(n) for n in names],
        F.sum(F.when(has, F.col("all_rows")).otherwise(0)).alias("join_partner"),
        F.sum(F.when(has, F.col("_together")).otherwise(0)).alias("together"),
    )
    checks = [*names, "join_partner", "together"]
    return sums.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("check"), F.coalesce(n, F.lit(0)).alias("n_rows")
                    )
                    for n in checks
                ]
            )
        )
    )


def removals(
    df: DataFrame, tests: Mapping[str, Column], join_key: str, partners: DataFrame, partner_key: str
) -> DataFrame:
    """Which filters or joins to take away so that rows come through.

    One row for every set of checks (the tests, and ``join_partner``) without which the others
    let rows pass: ``removed`` (names, in the order given, joined by commas; empty for none),
    ``n_removed``, ``n_rows``, and ``minimal``: no smaller part of the set would do.

    Each row becomes the mask of the checks it fails; equal masks are counted per join key, then
    over all, and a set of checks has the rows of all masks within it. The rows are read once, and
    at most two to the number of checks counters remain. A test that is NULL is failed, a NULL
    key has no partner, an empty table gives no rows.
    """
    names = [*tests, "join_partner"]
    if len(names) > MAX_CHECKS:
        raise ValueError(f"at most {MAX_CHECKS - 1} tests: each doubles the sets of checks")
    mask = F.lit(0)
    for bit, test in enumerate(tests.values()):
        mask = mask + F.when(test, 0).otherwise(1 << bit)
    per_key = df.groupBy(F.col(join_key).alias("_key"), mask.alias("_mask")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    known = partners.select(F.col(partner_key).alias("_partner")).distinct()
    joined = per_key.join(known, F.col("_key") == F.col("_partner"), "left")
    alone = F.when(F.col("_partner").isNull(), 1 << len(tests)).otherwise(0)
    masks = joined.groupBy((F.col("_mask") + alone).alias("mask")).agg(F.sum("_n").alias("n"))

    every = F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))
    holding = F.filter(every, lambda s: s.bitwiseAND(F.col("mask")) == F.col("mask"))
    sets = masks.select("mask", "n", F.explode(holding).alias("taken")).groupBy("taken").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("taken") == F.col("mask"), F.col("n"))).alias("own"),
    )
    shown = [F.when(F.col("taken").bitwiseAND(1 << bit) != 0, n) for bit, n in enumerate(names)]
    return sets.select(
        F.concat_ws(",", *shown).alias("removed"),
        F.bit_count("taken").cast("int").alias("n_removed"),
        "n_rows",
        # Rows of the set's own mask only: none fails a smaller part of it.
        F.coalesce(F.col("own") == F.col("n_rows"), F.lit(False)).alias("minimal"),
    )
