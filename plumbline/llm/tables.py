"""Intermediate tables in the shared folder, and graph components over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.kernels import mix
from plumbline.session import fresh_path, shared_folder

PART = 1 << 14  # bytes of a folded array that one row carries
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
ROW_GROUP = 1 << 24  # bytes of whole texts that an open Parquet file holds in memory
MAX_BITS = 1 << 27  # of a row filter: 16 MB


def pinned(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.pinned_path = path
    return table


def drop_pinned(*tables: DataFrame) -> None:
    """Deletes tables that ``pinned`` made: for those that nothing reads again, because what was
    made from them has been written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.pinned_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default: rows are whole texts, and a batch is
    held on both sides of every worker."""
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of any table, free of its other columns; null text becomes empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("bigint").alias("id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def folded(
    df: DataFrame,
    fill: Callable[[Iterator[pa.RecordBatch]], np.ndarray],
    size: int,
    kind: type,
    combine: np.ufunc,
) -> np.ndarray:
    """One array of ``size`` numbers: ``fill`` per partition, combined element by element.

    The driver gets ``size`` numbers however large the input is.
    """
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
    length = PART // np.dtype(kind).itemsize

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fill(batches)
        parts = [(k, own[k * length : (k + 1) * length]) for k in range(-(-size // length))]
        parts = [(k, part.tobytes()) for k, part in parts if part.any()]
        columns = {"part": [k for k, _ in parts], "data": [d for _, d in parts]}
        yield pa.RecordBatch.from_pydict(columns, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist()):
                part = np.frombuffer(data, kind)
                merged[k] = combine(merged[k], part) if k in merged else part
        columns = {"part": list(merged), "data": [d.tobytes() for d in merged.values()]}
        yield pa.RecordBatch.from_pydict(columns, schema)

    parts = df.mapInArrow(emit, "part int, data binary").repartition(16, "part")
    out = np.zeros(size, kind)
    for part, data in parts.mapInArrow(merge, "part int, data binary").collect():
        one = np.frombuffer(data, kind)
        out[part * length : part * length + len(one)] = one
    return out


class KeyFilter:
    """Bits for a set of bigint keys: every key of the set passes, and a few others."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys.view(np.uint64) + np.uint64(77)) % np.uint64(len(self.marks) * 8)).astype(
            np.int64
        )
        return (self.marks[at >> 3] >> (at & 7)) & 1 == 1


def key_filter(chosen: DataFrame, key: str) -> KeyFilter:
    """Filter for the values of ``key``, to be broadcast: its size follows their number up to
    MAX_BITS, beyond which more other keys pass."""
    wanted = max(1 << 18, chosen.count() * 16)
    size = min(MAX_BITS, 1 << (wanted - 1).bit_length()) // 8

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        own = np.zeros(size, np.uint8)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = (mix(keys.view(np.uint64) + np.uint64(77)) % np.uint64(size * 8)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return own

    return KeyFilter(folded(chosen.select(key), fill, size, np.uint8, np.bitwise_or))


def passing_rows(batch: pa.RecordBatch, key: str, own: KeyFilter, passing: bool = True) -> pa.RecordBatch:
    """The rows of a batch whose ``key`` passes the filter or is null, or all the others."""
    column = batch.column(batch.schema.get_field_index(key))
    keys = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    passed = own.passes(keys) | column.is_null().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(passed == passing))


def filtered(rows: DataFrame, key: str, own: KeyFilter, passing: bool = True) -> DataFrame:
    """The rows whose ``key`` (a bigint) passes the filter or is null, or all the others."""
    shared = rows.sparkSession.sparkContext.broadcast(own)  # MAX_BITS / 8 bytes at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield passing_rows(batch, key, shared.value, passing)

    return rows.mapInArrow(keep, rows.schema)


def marked_rows(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is in ``chosen``, and a few more, so that the caller's exact join
    need not shuffle all long texts. Rows with a null key pass."""
    return filtered(rows, key, key_filter(chosen, key))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it in any case."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A copy of the rows with a number of their own that stays the same, and its column."""
    row = free_name(df, "_row")
    return pinned(df.withColumn(row, F.monotonically_increasing_id()), label), row


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` (a bigint, never null) is not in ``dropped``.

    Only rows that may be in it are shuffled.
    """
    dropped = pinned(dropped.select(key).distinct(), "dropped")
    own = key_filter(dropped, key)
    near = filtered(rows, key, own).join(dropped, key, "left_anti")
    return filtered(rows, key, own, passing=False).unionByName(near)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); component: its smallest node.

    Alternating large and small stars: each node hands its neighbours to the smallest one it
    knows. Degrees are pre-aggregated, the edge list never grows, and no node's neighbours
    are gathered in one place. Stops when a round leaves the edges as they were.
    """
    spark: SparkSession = edges.sparkSession
    shared_folder(spark)
    edges = edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = edges.distinct().checkpoint()
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a != b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = small.distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        now = tuple(now.first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
