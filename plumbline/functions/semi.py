"""Semi-structured text: lenient paths, keys and flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: shape of one event parameter.
PARAMETER_LIST = (
    "array<struct<key string, value struct<string_value string, int_value bigint, "
    "float_value double, double_value double>>>"
)


def path(text: Column, where: str, kind: str) -> Column:
    """Value at a path; NULL where the text is no JSON or the path does not fit its shape.

    An object path on an array finds nothing: flatten the array first.
    """
    return F.try_variant_get(F.try_parse_json(text), where, kind)


def parameters(df: DataFrame, text: str, keep_empty: bool = False) -> DataFrame:
    """One row per element of a key/value parameter array, as ``key`` and ``value`` columns."""
    spread = F.explode_outer if keep_empty else F.explode
    return (
        df.withColumn("_p", spread(F.from_json(F.col(text), PARAMETER_LIST)))
        .withColumns({"key": F.col("_p.key"), "value": F.col("_p.value")})
        .drop("_p")
    )


def parameter_keys(text: Column) -> Column:
    """Keys of a key/value parameter array, in order; NULL where the text is none."""
    return F.from_json(text, PARAMETER_LIST)["key"]


def object_keys(text: Column) -> Column:
    """Keys of a JSON object as an array; NULL for anything else."""
    return F.json_object_keys(text)
