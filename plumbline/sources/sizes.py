"""Rows, files and bytes of tables, from listings and Parquet footers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.paths import file_path

SCHEMA = "table_name STRING, n_columns INT, n_files BIGINT, n_bytes BIGINT, n_rows BIGINT"
#: Tables that one job looks at; more are taken in several.
TOGETHER = 64


def _files(table: str, rows: DataFrame) -> DataFrame:
    """One row per file of a table. No column is read: tasks take row counts from footers."""
    return (
        rows.groupBy(file_path().alias("file"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(table).alias("table_name"), F.lit(len(rows.columns)).alias("n_columns"), "*")
    )


def parquet_sizes(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """table_name, n_columns, n_files, n_bytes, n_rows of Parquet tables by name and path.

    Files without rows have no row to tell about them, so they and tables of nothing else count
    by what the listing says: ``n_files`` and ``n_bytes`` come from it, only rows from footers.
    """
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    names = list(folders)
    parts = []
    for start in range(0, len(names), TOGETHER):
        some = names[start : start + TOGETHER]
        opened = {name: spark.read.parquet(folders[name]) for name in some}
        counted = reduce(DataFrame.unionAll, [_files(name, rows) for name, rows in opened.items()])
        listed = reduce(
            DataFrame.unionAll,
            [
                spark.read.format("binaryFile")
                .option("pathGlobFilter", "*.parquet")
                .option("recursiveFileLookup", True)
                .load(folders[name])
                .select(
                    F.lit(name).alias("table_name"),
                    F.lit(len(rows.columns)).alias("n_columns"),
                    F.lit(0).cast("bigint").alias("n"),
                    F.lit(1).cast("bigint").alias("files"),
                    F.col("length").alias("bytes"),
                )
                for name, rows in opened.items()
            ],
        )
        zero = F.lit(0).cast("bigint")
        found = counted.select("table_name", "n_columns", "n", zero.alias("files"), zero.alias("bytes"))
        parts.append(listed.unionAll(found))
    return (
        reduce(DataFrame.unionAll, parts)
        .groupBy("table_name", "n_columns")
        .agg(
            F.sum("files").alias("n_files"),
            F.sum("bytes").alias("n_bytes"),
            F.sum("n").alias("n_rows"),
        )
    )
