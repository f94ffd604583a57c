"""Ordered work inside groups of any size: rank, running total, previous and carried values.

A plain window sorts a whole group in one task. Here the rows are range-partitioned by
group and order, so a heavy group is spread over many partitions; the partition number is
pinned by a checkpoint, each (group, partition) piece is handled by an ordinary window, and
a small table with one row per piece carries totals and last values across pieces.

Rows that tie on group and order stay in one partition, so callers add a unique tie-breaker
or pre-aggregate equal rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import shared_folder

PIECE = "_piece"


def pin_pieces(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partitioned copy of ``df`` with its partition number, in the shared folder."""
    spark = df.sparkSession
    shared_folder(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *group, *order)
    return ranged.withColumn(PIECE, F.spark_partition_id()).checkpoint()


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Join in which NULL keys meet, as they do in a window or an aggregate."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def _before(pieces: DataFrame, group: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per piece, the sum of each total over the earlier pieces of its group."""
    earlier = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = pieces.groupBy(*group, PIECE).agg(*[c.alias(n) for n, c in totals.items()])
    return sums.select(
        *group, PIECE, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in totals]
    )


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows up to and including this one."""
    pieces = pin_pieces(df, group, order)
    offsets = _before(pieces, group, {"_offset": F.sum(value)})
    inside = (
        Window.partitionBy(*group, PIECE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        null_safe_join(pieces, offsets, [*group, PIECE])
        .withColumn(name, F.col("_offset") + F.sum(value).over(inside))
        .drop("_offset", PIECE)
    )


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... in ``order`` within each group."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(counted, group, order, "_one", name).drop("_one")


def previous_values(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, NULL for the first row of a group."""
    pieces = pin_pieces(df, group, order)
    last = pieces.groupBy(*group, PIECE).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    carried = last.select(
        *group,
        PIECE,
        F.lag("_last").over(Window.partitionBy(*group).orderBy(PIECE)).alias("_carried"),
    )
    inside = Window.partitionBy(*group, PIECE).orderBy(*order)
    before = F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    return (
        null_safe_join(pieces, carried, [*group, PIECE])
        .withColumn(name, F.coalesce(before, F.col("_carried"))["v"])
        .drop("_carried", PIECE)
    )


def carry_forward(
    df: DataFrame, group: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Fills NULLs in ``values`` with the last value before them in their group."""
    pieces = pin_pieces(df, group, order)
    lasts = pieces.groupBy(*group, PIECE).agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_last_{v}")
            for v in values
        ]
    )
    earlier = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = lasts.select(
        *group, PIECE, *[F.last(f"_last_{v}", True).over(earlier).alias(f"_before_{v}") for v in values]
    )
    inside = (
        Window.partitionBy(*group, PIECE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = {v: F.coalesce(F.last(v, True).over(inside), F.col(f"_before_{v}")) for v in values}
    return (
        null_safe_join(pieces, carried, [*group, PIECE])
        .withColumns(filled)
        .drop(PIECE, *[f"_before_{v}" for v in values])
    )


def first_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    count: int,
    name: str = "_rank",
    salts: int = 32,
) -> DataFrame:
    """The first ``count`` rows of each group, numbered from 1.

    For a small count Spark itself keeps the first rows of each group before the shuffle. For
    a larger one a first pass keeps those of each salted part of a group, so that no task
    sorts a whole heavy group; the result is the same.
    """
    whole = Window.partitionBy(*group).orderBy(*order)
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if count >= limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        kept = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= count)
        df = kept.drop("_salt", "_part")
    return df.withColumn(name, F.row_number().over(whole)).filter(F.col(name) <= count)
