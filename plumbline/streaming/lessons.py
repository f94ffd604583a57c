"""Incremental lesson append: a file stream into a store with unique patterns.

A store holds batches, one folder each by writer and number, and, once compacted, a base that
replaces them. Patterns have a bucket by their hash: the base has a folder per bucket, and
batches, which are small, are sorted by it. A batch reads only the buckets of its own patterns. A generation of the base counts when its commit is there, which
tells up to which batch of each writer it holds the lessons. Writers do not wait for each
other: if two add one pattern at the same time, the lesson of the smaller ``seq`` is the one
that is read, and compaction keeps it alone.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.lessons import new_lessons, with_norm
from plumbline.sources.paths import or_empty

LESSON_SCHEMA = (
    "seq BIGINT, ts STRING, error_type STRING, pattern STRING, fix STRING, example_sql STRING"
)
STORED_SCHEMA = f"{LESSON_SCHEMA}, norm STRING"
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64("norm"), F.lit(BUCKETS)).cast("int")


def _committed(spark: SparkSession, store: str) -> tuple[int, dict[str, int]]:
    """The newest generation of the base (0: none), and the last batch it holds per writer."""
    schema = "writer STRING, batch BIGINT, generation INT"
    path = os.path.join(store, "commits")
    commits = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    # One row per writer and generation.
    rows = commits.filter("writer IS NOT NULL").collect()
    newest = max((r["generation"] for r in rows), default=0)
    return newest, {r["writer"]: r["batch"] for r in rows if r["generation"] == newest}


def _rows(spark: SparkSession, store: str, buckets: list[int] | None) -> DataFrame:
    """Rows of the base and of later batches, in the given buckets or all; a pattern may come
    twice."""
    generation, done = _committed(spark, store)
    schema = f"{STORED_SCHEMA}, writer STRING, batch BIGINT"

    def read(folder: str, marks: str) -> DataFrame:
        path = os.path.join(store, folder)
        full = f"{schema}, {marks}, bucket INT" if marks else f"{schema}, bucket INT"
        rows = or_empty(spark, full, lambda: spark.read.schema(full).parquet(path))
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    later = read("batches", "")
    for writer, batch in done.items():
        later = later.filter(~((F.col("writer") == writer) & (F.col("batch") <= batch)))
    later = later.drop("bucket")
    if not generation:
        return later
    base = read("base", "generation INT").filter(F.col("generation") == generation)
    return base.drop("generation", "bucket").unionByName(later)


def _unique(rows: DataFrame) -> DataFrame:
    first = F.min_by(F.struct(*rows.columns), F.struct("seq", "writer", "batch"))
    return rows.groupBy("norm").agg(first.alias("_first")).select("_first.*")


def read_store(spark: SparkSession, store: str, buckets: list[int] | None = None) -> DataFrame:
    """All stored lessons, one per pattern, with the writer and batch that wrote each; no
    store, no lessons."""
    return _unique(_rows(spark, store, buckets))


def append_batch(batch: DataFrame, batch_id: int, store: str, writer: str = "batch") -> None:
    """Write what is new in this batch to the batch's own folder.

    The folder is overwritten, and what it or a later batch of this writer held does not count
    as stored, so a batch that is run again after a failure leaves the same rows.
    """
    spark = batch.sparkSession
    # At most BUCKETS numbers.
    buckets = [r["bucket"] for r in with_norm(batch).select(_bucket().alias("bucket")).distinct().collect()]
    own = (F.col("writer") == writer) & (F.col("batch") >= batch_id)
    stored = _rows(spark, store, buckets).filter(~own).select("norm")
    folder = os.path.join(store, "batches", f"writer={writer}", f"batch={batch_id}")
    fresh = new_lessons(batch, stored).withColumn("bucket", _bucket())
    sorted_ = fresh.repartitionByRange("bucket").sortWithinPartitions("bucket")
    sorted_.write.mode("overwrite").parquet(folder)


def compact(spark: SparkSession, store: str) -> int:
    """Write a new generation of the base from all that is stored now, and commit it.

    A compaction that fails before its commit leaves the store as it was; batches that arrive
    meanwhile stay batches. One compaction runs at a time. Earlier files are left in place for
    readers that still use them.
    """
    generation, done = _committed(spark, store)
    schema = f"{STORED_SCHEMA}, writer STRING, batch BIGINT, bucket INT"
    path = os.path.join(store, "batches")
    batches = or_empty(spark, schema, lambda: spark.read.schema(schema).parquet(path))
    upto = dict(done)
    for r in batches.groupBy("writer").agg(F.max("batch").alias("batch")).collect():
        upto[r["writer"]] = max(r["batch"], upto.get(r["writer"], -1))
    if upto == done:
        return generation
    known = F.lit(False)
    for writer, batch in upto.items():
        known |= (F.col("writer") == writer) & (F.col("batch") <= batch)
    rows = _unique(_rows(spark, store, None).filter(known)).withColumn("bucket", _bucket())
    target = os.path.join(store, "base", f"generation={generation + 1}")
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
    commit = spark.createDataFrame(list(upto.items()), "writer STRING, batch BIGINT").coalesce(1)
    commit.write.mode("overwrite").parquet(
        os.path.join(store, "commits", f"generation={generation + 1}")
    )
    return generation + 1


def start(
    spark: SparkSession, source: str, store: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append every lesson file that is there now, then stop.

    Batches are numbered per checkpoint, so its name keeps the folders of streams with
    different checkpoints apart.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    incoming = (
        spark.readStream.schema(LESSON_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    return (
        incoming.writeStream.foreachBatch(lambda df, i: append_batch(df, i, store, writer))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
