"""Distinct keys in all trailing windows of days, from one scan.

Each key becomes a set of bits, one per day on which it occurs, in words of 64 days. The sets of
two inputs merge by OR, so they can be kept per month or per shard and put together later, and
every window of every length is read off them: a key counts if its set meets the window's bits.
Rows are reduced to one per key and task before the only shuffle, so a key with a third of all
rows is one row per task.

Defined cases: rows with a NULL key or time, and days outside the range, do not count; a window
without rows counts 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def _n_words(first: date, last: date) -> int:
    return (last - first).days // WORD + 1


def day_masks(rows: DataFrame, key: Column, ts: Column, first: date, last: date) -> DataFrame:
    """``key`` and its days from ``first`` to ``last`` as words ``w0``, ``w1``, ...

    The range is compared with the raw column, so it reaches the scan.
    """
    day_after = F.lit(last + timedelta(1)).cast("timestamp_ntz")
    inside = rows.filter((ts >= F.lit(first).cast("timestamp_ntz")) & (ts < day_after))
    days = inside.filter(key.isNotNull()).select(
        key.alias("key"), F.date_diff(F.to_date(ts), F.lit(first)).alias("_day")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_day") % WORD)
    in_word = F.floor(F.col("_day") / WORD)
    return days.groupBy("key").agg(
        *[
            F.coalesce(F.bit_or(F.when(in_word == k, bit)), F.lit(0).cast("long")).alias(f"w{k}")
            for k in range(_n_words(first, last))
        ]
    )


def merged_masks(parts: Sequence[DataFrame]) -> DataFrame:
    """Masks of several inputs over the same range as those of all of them together."""
    words = [c for c in parts[0].columns if c != "key"]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("key").agg(*[F.bit_or(w).alias(w) for w in words])


def _meets(first: date, end: date, days: int) -> Column:
    """Whether a key occurs in the ``days`` days up to ``end``."""
    last = (end - first).days
    found = []
    for k in range(last // WORD + 1):
        bits = sum(
            1 << (d - k * WORD)
            for d in range(last - days + 1, last + 1)
            if k * WORD <= d < (k + 1) * WORD
        )
        if bits:
            signed = bits - (1 << WORD) if bits >> (WORD - 1) else bits
            found.append(F.col(f"w{k}").bitwiseAND(F.lit(signed).cast("long")) != 0)
    return reduce(or_, found)


def trailing_counts(
    masks: DataFrame, first: date, ends: Sequence[date], lengths: Sequence[int]
) -> DataFrame:
    """``end_day``, ``days``, ``n_keys``: keys that occur in the ``days`` days up to ``end_day``.

    One counter per end and length is all that leaves a task.
    """
    if min(ends) - timedelta(max(lengths) - 1) < first or min(lengths) < 1:
        raise ValueError("a window begins before the first day of the masks, or is empty")
    windows = [(end, days) for end in ends for days in lengths]
    counts = masks.agg(
        *[F.count_if(_meets(first, end, n)).alias(f"c{i}") for i, (end, n) in enumerate(windows)]
    )
    rows = [
        F.struct(F.lit(end).alias("end_day"), F.lit(n).alias("days"), F.col(f"c{i}").alias("n_keys"))
        for i, (end, n) in enumerate(windows)
    ]
    return counts.select(F.inline(F.array(*rows)))


def trailing_distinct(
    rows: DataFrame, key: Column, ts: Column, first_end: date, last_end: date, lengths: Sequence[int]
) -> DataFrame:
    """``trailing_counts`` for every day from ``first_end`` to ``last_end``, from one scan."""
    first = first_end - timedelta(max(lengths) - 1)
    ends = [first_end + timedelta(k) for k in range((last_end - first_end).days + 1)]
    return trailing_counts(day_masks(rows, key, ts, first, last_end), first, ends, lengths)
