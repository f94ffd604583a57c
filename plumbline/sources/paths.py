"""Small helpers around input paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import fresh_path


def or_empty(spark: SparkSession, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` opens, or no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_path() -> Column:
    """Path of the file a row was read from, with escapes undone."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def stem(path: Column, suffix: str) -> Column:
    """Name before the suffix, of a file or of the folder a job wrote under that name."""
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}(?:/[^/]*)?$", 1)


def positioned(rows: DataFrame, name: str = "pos") -> DataFrame:
    """Adds the position of each row over all files, files in order of their names.

    Row ids run on inside one block of a file but say nothing about the order of blocks; a
    small table with the rows per block puts the blocks in order. The marks are given in one
    scan and written, because another scan may split the files in another way.
    """
    spark = rows.sparkSession
    marked = rows.select(
        "*",
        file_path().alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_i"),
    )
    path = fresh_path(spark, "positioned")
    marked.write.parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        marked.groupBy("_file", "_block")
        .agg(F.min("_i").alias("_head"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    return (
        marked.join(blocks, ["_file", "_block"])
        .withColumn(name, F.col("_offset") + F.col("_i") - F.col("_head"))
        .drop("_file", "_block", "_i", "_head", "_offset")
    )
