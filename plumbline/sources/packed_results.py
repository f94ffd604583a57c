"""Many result tables in few files, with a manifest.

A store is a folder of batches. Each holds ``records``, rows of all its results in order of
key and position and cut by size alone, so that a heavy result is spread over files and a light
one shares them, and ``manifest``, one row per result with its shape and header, written last:
a batch without a finished manifest is not read. Of a result in several batches the newest
one counts. Reading by key uses the key ranges that Parquet keeps for files and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.grading import cells_of_text
from plumbline.sources.paths import or_empty

KEY = ["instance_id", "variant"]
RECORDS = "instance_id STRING, variant INT, row_idx BIGINT, values ARRAY<STRING>"
MANIFEST = (
    "instance_id STRING, variant INT, n_rows BIGINT, n_cols INT, header ARRAY<STRING>, "
    "read_error STRING"
)


def records_of(
    rows: DataFrame, instance: str, pos: str, columns: list[str], variant: str | None = None
) -> DataFrame:
    """Records of a table of results that all have the same columns; ``pos`` is the row's
    place from 0."""
    return rows.select(
        F.col(instance).cast("string").alias("instance_id"),
        (F.col(variant).cast("int") if variant else F.lit(0)).alias("variant"),
        F.col(pos).cast("bigint").alias("row_idx"),
        F.array(*[F.col(c).cast("string") for c in columns]).alias("values"),
    )


def headers_of(records: DataFrame, columns: list[str]) -> DataFrame:
    """The same header for all results that have records."""
    header = F.array(*map(F.lit, columns)).alias("header")
    return records.select(*KEY).distinct().select("*", header)


def store(path: str, batch: int, records: DataFrame, headers: DataFrame) -> None:
    """Adds a batch, or replaces it. ``headers`` names all its results, those without rows
    too: instance_id, variant, header and perhaps read_error. Records of other results, and
    records of results that cannot be read, are not kept; a record wider than its header makes
    its result unreadable.

    Keys must not be NULL; their rows are left out.
    """
    spark = records.sparkSession
    base = f"{path}/batch={batch}"
    if "read_error" not in headers.columns:
        headers = headers.withColumn("read_error", F.lit(None).cast("string"))
    headers = headers.select(*KEY, "header", "read_error").dropna(subset=KEY)
    readable = headers.filter("read_error IS NULL").select(*KEY)
    # By range and not by key: one result may hold a third of all rows.
    kept = records.join(readable, KEY, "left_semi").select(*KEY, "row_idx", "values")
    ordered = kept.repartitionByRange(*KEY, "row_idx").sortWithinPartitions(*KEY, "row_idx")
    ordered.write.mode("overwrite").parquet(f"{base}/records")
    shapes = (
        spark.read.schema(RECORDS)
        .parquet(f"{base}/records")
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("values")).alias("widest"))
    )
    n_cols = F.coalesce(F.size("header"), F.lit(0))
    error = F.when(F.col("widest") > n_cols, "Error tokenizing data")
    headers.join(shapes, KEY, "left").select(
        *KEY,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        n_cols.cast("int").alias("n_cols"),
        "header",
        F.coalesce("read_error", error).alias("read_error"),
    ).write.mode("overwrite").parquet(f"{base}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per result, of its newest batch: key, batch, shape, header, read_error."""
    rows = or_empty(
        spark,
        f"{MANIFEST}, batch INT",
        lambda: spark.read.schema(f"{MANIFEST}, batch INT")
        .option("basePath", path)
        .parquet(f"{path}/batch=*/manifest"),
    )
    columns = [c for c in rows.columns if c not in KEY]
    newest = rows.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "batch").alias("one"))
    return newest.select(*KEY, "one.*")


def read(
    spark: SparkSession, path: str, ids: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``tables`` and ``cells`` for grading, of all results or of the named instances."""
    known = manifest(spark, path)
    records = or_empty(
        spark,
        f"{RECORDS}, batch INT",
        lambda: spark.read.schema(f"{RECORDS}, batch INT")
        .option("basePath", path)
        .parquet(f"{path}/batch=*/records"),
    )
    if ids is not None:
        known = known.filter(F.col("instance_id").isin(ids))
        records = records.filter(F.col("instance_id").isin(ids))
    good = known.filter("read_error IS NULL").select(*KEY, "batch")
    cells = cells_of_text(
        records.join(good, [*KEY, "batch"], "left_semi").select(
            *KEY, "row_idx", F.posexplode("values").alias("col_idx", "raw")
        )
    )
    return (
        known.select(
            *KEY, "n_rows", "n_cols", F.col("read_error").isNull().alias("readable"), "read_error"
        ),
        cells,
    )
