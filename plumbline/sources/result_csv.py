"""Result tables at rest: CSV files with a header, and the SQL texts that made them.

A result is a file ``<id>.csv`` or a folder of that name with part files, as a Spark job
writes it; every part has the header, and parts follow each other by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.grading import cells_of_text
from plumbline.session import fresh_path
from plumbline.sources.csv_records import read_records
from plumbline.sources.paths import file_path, or_empty, stem

NO_COLUMNS = "No columns to parse from file"
BROKEN = "Error tokenizing data"
# Fixed value: a gold file is named by its id and, for a further answer, a digit or letter.
VARIANT = r"^(.+)_([0-9a-z])$"


def _plain_path(file: Column) -> Column:
    return F.regexp_replace(file, "^file:/+", "/")


def _saved(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, records): one row per file with its shape, one per record."""
    rows, broken = read_records(spark, path)
    # Spark's listing, on the driver in any case, knows empty files too, which no reader shows.
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    names = or_empty(spark, "value STRING", lambda: reader.text(path)).inputFiles()
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    listing = spark.createDataFrame([(n,) for n in names], "path STRING").select(
        decoded.alias("path")
    )
    filled = F.transform("values", lambda v, k: F.when(v.isNotNull(), k + 1).otherwise(0))
    shapes = rows.groupBy("file").agg(
        F.max(F.when(F.col("i") == 1, F.size("values"))).alias("n_cols"),
        F.max(F.array_max(filled)).alias("widest"),
        (F.max("i") - 1).alias("n_rows"),
    )
    earlier = Window.partitionBy("name").orderBy("file").rowsBetween(
        Window.unboundedPreceding, -1
    )
    known = (
        listing.select(_plain_path(F.col("path")).alias("file"))
        .join(shapes, "file", "left")
        .join(broken.withColumn("open", F.lit(True)), "file", "left")
        .withColumn("name", stem(F.col("file"), "csv"))
        .withColumn("offset", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    )
    # One row per file, kept so that shapes are not counted again with every use.
    return _saved(spark, known, "csv-files"), rows


def _tables(files: DataFrame) -> DataFrame:
    """One row per result: shape, and why it cannot be read."""
    n_cols = F.max("n_cols")
    bad = F.max(F.coalesce(F.col("open"), F.col("widest") > F.col("n_cols")))
    error = F.when(bad, BROKEN).when(F.coalesce(n_cols, F.lit(0)) == 0, NO_COLUMNS)
    return files.groupBy("name").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(n_cols, F.lit(0)).cast("int").alias("n_cols"),
        error.isNull().alias("readable"),
        error.alias("read_error"),
    )


def _cells(files: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells of the readable results; the files side has one row per file."""
    good = files.join(tables.filter("readable").select("name"), "name", "left_semi")
    spread = rows.join(good.select("file", "name", "n_cols", "offset"), "file").filter("i > 1")
    return cells_of_text(
        spread.select(
            F.col("name").alias("instance_id"),
            F.lit(0).alias("variant"),
            (F.col("offset") + F.col("i") - 2).alias("row_idx"),
            F.posexplode(F.slice("values", F.lit(1), F.col("n_cols"))).alias("col_idx", "raw"),
        )
    )


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``tables`` and ``cells`` of all predicted results under a folder, for grading."""
    files, rows = _read(spark, path)
    tables = _tables(files)
    return (
        tables.select(
            F.col("name").alias("instance_id"),
            F.lit(0).alias("variant"),
            "n_rows",
            "n_cols",
            "readable",
            "read_error",
        ),
        _cells(files, rows, tables),
    )


def read_golds(
    spark: SparkSession, path: str, standards: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``tables`` and ``cells`` of all gold tables: ``<id>``, ``<id>_0`` to ``_9``, ``_a`` to
    ``_z``, in this order and numbered from 0; unreadable ones are skipped.

    The ids of the standards decide what is a suffix: a file may be the first gold of one id
    and a further gold of another.
    """
    files, rows = _read(spark, path)
    tables = _tables(files)
    ids = standards.select("instance_id")
    named = tables.filter("readable").select("name", "n_rows", "n_cols")
    whole = named.withColumns({"instance_id": F.col("name"), "suffix": F.lit("")})
    split = named.filter(F.col("name").rlike(VARIANT)).withColumns(
        {
            "instance_id": F.regexp_extract("name", VARIANT, 1),
            "suffix": F.regexp_extract("name", VARIANT, 2),
        }
    )
    in_order = Window.partitionBy("instance_id").orderBy("suffix")
    golds = (
        whole.unionByName(split)
        .join(ids, "instance_id", "left_semi")
        .withColumn("variant", F.row_number().over(in_order) - 1)
    )
    cells = _cells(files, rows, tables).withColumnRenamed("instance_id", "name").drop("variant")
    return (
        golds.select("instance_id", "variant", "n_rows", "n_cols", F.lit(True).alias("readable")),
        cells.join(golds.select("name", "instance_id", "variant"), "name").select(
            "instance_id", "variant", "col_idx", "row_idx", "num", "txt", "is_truth"
        ),
    )


def read_sql_texts(spark: SparkSession, path: str) -> DataFrame:
    """SQL text per instance, from files or folders ``<id>.sql``."""
    texts = or_empty(
        spark,
        "instance_id STRING, sql STRING",
        lambda: spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(file_path().alias("file"), F.col("value").alias("sql"))
        .filter(F.col("file").rlike(r"\.sql(/part-[^/]*)?$"))
        .select(stem(F.col("file"), "sql").alias("instance_id"), "sql"),
    )
    return texts


def store_result(
    spark: SparkSession, path: str, instance_id: str, sql: str, result: DataFrame | None
) -> None:
    """Keep the SQL text and, where there is one, the result as CSV with a header."""
    text = spark.createDataFrame([(sql,)], "value STRING").coalesce(1)
    text.write.mode("overwrite").option("lineSep", "\n").text(f"{path}/{instance_id}.sql")
    if result is not None:
        result.write.mode("overwrite").option("header", True).option("escape", '"').csv(
            f"{path}/{instance_id}.csv"
        )
