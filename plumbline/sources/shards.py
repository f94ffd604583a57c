"""Date-sharded inputs: one table per key becomes one table with a key column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED_SHARDS = 100_000


def day_shard(ts: Column) -> Column:
    """``yyyyMMdd`` text of a timestamp."""
    return F.date_format(ts, "yyyyMMdd")


def trailing_days(ts: Column, end_day: str, days: int) -> Column:
    """Rows of the last ``days`` days, the end day included.

    The bounds are constants compared with the raw column, so the filter reaches the scan.
    """
    end = F.lit(end_day).cast("date")
    return (ts >= F.date_sub(end, days - 1).cast("timestamp_ntz")) & (
        ts < F.date_add(end, 1).cast("timestamp_ntz")
    )


def coded_days_between(ts: Column, low: int, high: int) -> Column:
    """``yyyymmdd(ts) BETWEEN low AND high`` written on the raw column, for pushdown."""

    def day(code: int) -> Column:
        return F.to_date(F.lit(str(code)), "yyyyMMdd")

    return (ts >= day(low).cast("timestamp_ntz")) & (
        ts < F.date_add(day(high), 1).cast("timestamp_ntz")
    )


def write_shards(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """One folder per shard key; the rebalance hint splits a heavy day over several files."""
    df.hint("rebalance", key).write.mode(mode).partitionBy(key).parquet(path)


def read_shards(
    spark: SparkSession, path: str, key: str, low: str | None = None, high: str | None = None
) -> DataFrame:
    """All shards from ``low`` to ``high``; the bounds prune folders, not rows.

    The key is declared as text, so a folder named ``0042`` keeps its zeros. Shards may differ in
    their columns: one missing in some shard is NULL there (Spark merges the footers by tasks).
    """
    fields = spark.read.option("mergeSchema", True).parquet(path).schema.fields
    schema = ", ".join(
        f"`{f.name}` {'string' if f.name == key else f.dataType.simpleString()}" for f in fields
    )
    shards = spark.read.schema(schema).parquet(path)
    if low is not None:
        shards = shards.filter(F.col(key) >= low)
    if high is not None:
        shards = shards.filter(F.col(key) <= high)
    return shards


def listed_shards(shards: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The shards whose key is in the column ``key`` of ``listed``, a table made by any query.

    While there are at most ``LISTED_SHARDS`` keys, the join prunes folders at run time: those of
    other shards are not opened. The comparison with the empty text lets every key pass; it tells
    the optimiser that the list selects.
    """
    keys = listed.select(key).distinct().filter(F.col(key) >= "")
    small = keys.count() <= LISTED_SHARDS
    return shards.join(F.broadcast(keys) if small else keys, key, "left_semi")


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """Separate shard tables as one input; a column missing in some shard is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
