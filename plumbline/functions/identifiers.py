"""Table and column names: shard keys and quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a shard name is a prefix, an underscore and 4 to 8 digits at the end.
SHARD_NAME = r"^(.+?)_(\d{4,8})$"


def shard_prefix(name: Column) -> Column:
    """Part before the last 4-8 digit group; NULL for a name that is no shard."""
    return F.when(name.rlike(SHARD_NAME), F.regexp_extract(name, SHARD_NAME, 1))


def shard_key(name: Column) -> Column:
    return F.when(name.rlike(SHARD_NAME), F.regexp_extract(name, SHARD_NAME, 2))


def quoted(name: Column) -> Column:
    """Double quotes around every name that is not all upper case."""
    return F.when(name != F.upper(name), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)
