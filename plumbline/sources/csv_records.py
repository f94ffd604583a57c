"""Records of CSV files whose quoted values may hold line ends, read by byte ranges.

Spark splits the files into blocks and these into lines; whether a line starts inside a quoted
value depends on all lines before it. Each line is therefore read as a change of state: what
follows it if it starts outside a quoted value, and what if inside. A run of lines is such a
change as well, so one scan gives the change of every block, a running composition over the
blocks of a file gives the state each block starts in, and lines find their record's number
without any file being in one task. Only records of several lines are put together.

Quotes follow the usual lenient rule: one at the start of a field opens it, two inside stand for
one, whatever follows the closing one belongs to the field, and elsewhere they are plain
characters. Lines end with a line feed, before which a carriage return is left out.
Records have any number of fields; blank lines are no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import fresh_path
from plumbline.sources.paths import file_path, or_empty

# Possessive, so that long values need no stack. A field that is not closed is not matched.
_OPEN = r'"[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:{_OPEN}"[^,]*+|[^",][^,]*+|)'
_OUTSIDE = rf"^{_FIELD}(?:,{_FIELD})*+\z"
_FROM_INSIDE = rf'^[^"]*+(?:""[^"]*+)*+"[^,]*+(?:,{_FIELD})*+\z'
_QUOTED = rf'^"([^"]*+(?:""[^"]*+)*+)"([^,]*+)\z'
LINES = "value STRING, file STRING, block BIGINT"


def _saved(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _odd(swaps: Column) -> Column:
    return (swaps % 2) == 1


def _after(known: Column, swaps: Column) -> Column:
    """State after a number of swaps, true inside: from a known state, or that of the start."""
    return F.coalesce(known["inside"] != _odd(swaps - known["swaps"]), _odd(swaps))


def _lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Lines with their state before them and the running number of records in their block.

    ``known`` tells whether the state before follows from the block itself; otherwise ``inside``
    is the change since the block's start. ``n0`` and ``n1`` count the records begun so far if
    the block starts outside or inside a value.
    """
    quoted = F.contains("value", F.lit('"'))
    out = ~quoted | F.col("value").rlike(_OUTSIDE)
    back = quoted & F.col("value").rlike(_FROM_INSIDE)
    kinds = lines.select(
        "*",
        F.monotonically_increasing_id().alias("i"),
        out.alias("out"),
        back.alias("back"),
        (F.trim(F.regexp_replace("value", r"\r\z", "")) != "").alias("filled"),
    )
    order = Window.partitionBy("file", "block").orderBy("i")
    until, before = (
        order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1)
    )
    swap = (~F.col("out") & F.col("back")).cast("bigint")
    fixed = F.when(
        F.col("out") == F.col("back"), F.struct((~F.col("out")).alias("inside"), "swaps")
    )
    rows = (
        kinds.withColumn("swaps", F.sum(swap).over(until))
        .withColumn("fixed", fixed)
        .withColumn("last", F.last("fixed", ignorenulls=True).over(before))
        .withColumn("known", F.col("last").isNotNull())
        .withColumn("inside", _after(F.col("last"), F.col("swaps") - swap))
    )
    begins = [F.col("filled") & (F.col("inside") == F.lit(False))]
    begins.append(F.col("filled") & (F.col("inside") != F.col("known")).eqNullSafe(F.lit(True)))
    for k, begin in enumerate(begins):
        rows = rows.withColumn(f"n{k}", F.sum(begin.cast("bigint")).over(until))
    return _saved(spark, rows.drop("last"), "csv-lines")


def _blocks(lines: DataFrame) -> DataFrame:
    """file, block, entered (inside a value), offset (records begun before), ended (inside)."""
    blocks = lines.groupBy("file", "block").agg(
        F.max(F.when(F.col("fixed").isNotNull(), F.struct("i", "fixed"))).alias("last"),
        F.max_by("swaps", "i").alias("swaps"),
        F.max("n0").alias("n0"),
        F.max("n1").alias("n1"),
    )
    fixed = F.col("last")["fixed"]
    blocks = blocks.select(
        "file",
        "block",
        "n0",
        "n1",
        F.when(fixed.isNotNull(), _after(fixed, F.col("swaps"))).alias("fixed"),
        (fixed.isNull() & _odd(F.col("swaps"))).cast("bigint").alias("swap"),
    )
    order = Window.partitionBy("file").orderBy("block")
    until, before = (
        order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1)
    )
    known = F.when(
        F.col("fixed").isNotNull(), F.struct(F.col("fixed").alias("inside"), "swaps")
    )
    blocks = blocks.withColumn("swaps", F.sum("swap").over(until)).withColumn("known", known)
    entered = _after(F.last("known", True).over(before), F.col("swaps") - F.col("swap"))
    ended = _after(F.last("known", True).over(until), F.col("swaps"))
    begun = F.when(F.col("entered"), F.col("n1")).otherwise(F.col("n0"))
    return (
        blocks.withColumn("entered", entered)
        .withColumn("ended", ended)
        .withColumn("offset", F.coalesce(F.sum(begun).over(before), F.lit(0)))
        .select("file", "block", "entered", "offset", "ended")
    )


def fields(record: Column) -> Column:
    """The values of a record: NULL for an empty field, '' for an empty quoted one."""
    raw = F.regexp_extract_all(
        F.concat(F.lit(","), record), F.lit(rf",({_FIELD[3:-1]})"), F.lit(1)
    )

    def value(field: Column) -> Column:
        inner = F.replace(F.regexp_extract(field, _QUOTED, 1), F.lit('""'), F.lit('"'))
        return (
            F.when(field.startswith('"'), F.concat(inner, F.regexp_extract(field, _QUOTED, 2)))
            .when(field != "", field)
        )

    return F.transform(raw, value)


def read_records(
    spark: SparkSession, path: str, names: str = "*.csv"
) -> tuple[DataFrame, DataFrame]:
    """(records, open files) of all files below a path whose names fit the pattern.

    Records: file, i (from 1, the header) and values. A file that ends inside a quoted value
    has no records and is named by the second table.
    """
    reader = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", names)
        .option("lineSep", "\n")
    )
    raw = or_empty(
        spark,
        LINES,
        lambda: reader.text(path).select(
            "value",
            F.regexp_replace(file_path(), "^file:/+", "/").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        ),
    )
    lines = _lines(spark, raw)
    blocks = _saved(spark, _blocks(lines), "csv-blocks")
    ends = blocks.groupBy("file").agg(F.max_by("ended", "block").alias("open"))
    broken = ends.where("open").select("file")
    inside = F.col("inside") != (~F.col("known") & F.col("entered"))
    placed = (
        lines.join(blocks.drop("ended"), ["file", "block"])
        .join(broken, "file", "left_anti")
        .select(
            "file",
            (F.col("offset") + F.when(F.col("entered"), F.col("n1")).otherwise(F.col("n0"))).alias("i"),
            F.struct("block", F.col("i").alias("line"), "value").alias("part"),
            (inside | F.col("filled")).alias("filled"),
            (~inside & F.col("out")).alias("whole"),
        )
        .where("filled")
    )
    single = placed.where("whole").select("file", "i", F.col("part.value").alias("record"))
    joined = placed.where("not whole").groupBy("file", "i").agg(
        F.array_join(F.sort_array(F.collect_list("part"))["value"], "\n").alias("record")
    )
    records = single.unionByName(joined).select(
        "file", "i", fields(F.regexp_replace("record", r"\r\z", "")).alias("values")
    )
    return _saved(spark, records, "csv-records"), broken
