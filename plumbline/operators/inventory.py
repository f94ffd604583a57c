"""Which paths a column of JSON texts has, with the kinds of their values and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

ROOT = "$"
ELEMENT = "[*]"
NO_JSON = "no json"
KINDS = ["object", "array", "text", "integer", "decimal", "boolean", "null", NO_JSON]
#: How the type of a variant begins, by kind; a number with a fraction is any other type.
_TYPES = {
    "object": "OBJECT",
    "array": "ARRAY",
    "text": "STRING",
    "integer": "BIGINT",
    "boolean": "BOOLEAN",
    "null": "VOID",
}
_PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def kind_of(value: Column) -> Column:
    """Kind of a variant; whole numbers too long for 64 bits are integers as well."""
    kind = F.schema_of_variant(value)
    found = F.when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
    for name, start in _TYPES.items():
        found = found.when(F.startswith(kind, F.lit(start)), name)
    return found.otherwise("decimal")


def _step(key: Column) -> Column:
    """What a key, or a place of an array (no key), adds to a path."""
    escaped = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = F.when(key.rlike(_PLAIN_KEY), F.concat(F.lit("."), key)).otherwise(
        F.concat(F.lit('["'), escaped, F.lit('"]'))
    )
    return F.when(key.isNull(), ELEMENT).otherwise(named)


def _level(nodes: DataFrame) -> DataFrame:
    """path, kind, value: values only of objects and arrays, which have a further level."""
    kind = F.when(F.col("value").isNull(), NO_JSON).otherwise(kind_of(F.col("value")))
    below = kind.isin("object", "array")
    nodes = nodes.select("path", kind.alias("kind"), F.when(below, F.col("value")).alias("value"))
    return nodes.checkpoint()


def path_inventory(rows: DataFrame, text: Column) -> DataFrame:
    """path, kind, n_values of every path in the texts.

    The texts are read once; each level of nesting is one table of nodes, made from the objects
    and arrays of the level above, until a level has none. Places of an array share the path
    ``[*]``, values of different kinds on one path are told apart, and counts are pre-aggregated
    before anything is shuffled, so a path that all rows have is a few counters.

    NULL texts are passed over; a text that is no JSON counts as ``no json`` at the root; a JSON
    null is a value; empty objects and arrays have no further paths; no rows give no paths.
    """
    shared_folder(rows.sparkSession)
    texts = rows.select(text.cast("string").alias("text")).where("text IS NOT NULL")
    level = _level(texts.select(F.lit(ROOT).alias("path"), F.try_parse_json("text").alias("value")))
    levels = []
    while True:
        levels.append(level.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n_values")))
        inner = level.where("value IS NOT NULL")
        if inner.isEmpty():
            break
        parts = inner.select(F.col("path").alias("above"), "value").lateralJoin(
            rows.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "key", "part")
        )
        path = F.concat("above", _step(F.col("key")))
        level = _level(parts.select(path.alias("path"), F.col("part").alias("value")))
    # A path belongs to one level, so the counts of the levels are never added.
    return reduce(DataFrame.unionAll, levels)
