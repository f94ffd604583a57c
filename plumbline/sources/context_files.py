"""Schema files, documents and the live catalogue."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.sources.csv_records import read_records
from plumbline.sources.paths import file_path, or_empty


def read_ddl(spark: SparkSession, path: str) -> DataFrame:
    """Tables of every ``DDL.csv`` below ``<path>/<db_id>/``; the folder names the schema.

    Each file's own header, of any width, says which column holds the name and which the DDL.
    ``pos`` numbers the rows of all files, files in order of their paths.
    """
    root = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path.rstrip("/")).removeprefix("./") + "/"
    rows, _ = read_records(spark, path, "DDL.csv")
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("file").agg(
        F.max("i").alias("n"), F.max(F.when(F.col("i") == 1, F.col("values"))).alias("head")
    )
    # One row per file.
    heads = heads.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    below = F.substr("file", F.instr("file", root) + F.lit(len(root)))

    def cell(name: str) -> Column:
        at = F.array_position(F.transform("head", lambda c: F.lower(F.trim(c))), name)
        return F.when(at > 0, F.get("values", (at - 1).cast("int")))

    return (
        rows.join(heads, "file")
        .filter("i > 1")
        .select(
            F.substring_index(below, "/", 1).alias("db_id"),
            F.regexp_extract("file", r"([^/]+)/DDL\.csv$", 1).alias("schema_name"),
            cell("table_name").alias("table_name"),
            (F.col("offset") + F.col("i")).alias("pos"),
            cell("ddl").alias("ddl"),
        )
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every text file below a folder: file name and whole content."""
    return or_empty(
        spark,
        "name STRING, content STRING",
        lambda: spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content")),
    )


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current catalogue, ordered by schema and name."""
    rows = [
        (".".join(t.namespace or []), t.name) for t in spark.catalog.listTables()
    ]
    tables = spark.createDataFrame(rows, "schema_name STRING, table_name STRING")
    return tables.orderBy("schema_name", "table_name")


def list_columns(spark: SparkSession, tables: list[tuple[str, str]]) -> DataFrame:
    """Columns with type and position of the given (schema, table) pairs."""
    rows = [
        (schema, table, position, field.name, field.dataType.simpleString().upper())
        for schema, table in tables
        for position, field in enumerate(
            spark.table(f"{schema}.{table}" if schema else table).schema.fields, 1
        )
    ]
    columns = spark.createDataFrame(
        rows,
        "schema_name STRING, table_name STRING, ordinal INT, column_name STRING, data_type STRING",
    )
    return columns.orderBy("schema_name", "table_name", "ordinal")
