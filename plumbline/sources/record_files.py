"""Lessons, step logs and hard failures at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import strip
from plumbline.operators import lessons as L
from plumbline.sources.paths import or_empty, positioned

STEP = (
    "struct<step string, timestamp string, elapsed_ms bigint, attempt bigint, loop string, "
    "sql string, score double, passed boolean, failed_count bigint, success boolean, "
    "time_ms bigint, error string, pattern string, fix string, rows bigint, db_id string, "
    "ddl_chars bigint, docs_chars bigint, subtask_count bigint, "
    "subtasks array<struct<id bigint, desc string>>, transcript_length bigint, "
    "errors_caught bigint, type string>"
)
LOG_SCHEMA = f"instance_id STRING, total_elapsed_ms BIGINT, steps ARRAY<{STEP}>"
FAILURE_SCHEMA = (
    "instance_id STRING, failure_type STRING, timestamp STRING, details MAP<STRING, STRING>"
)


def read_lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lessons of a markdown store, in the order they were written; no file, no lessons."""
    entries = or_empty(
        spark,
        "value STRING, seq BIGINT",
        lambda: positioned(spark.read.option("lineSep", L.SEPARATOR).text(path), "seq"),
    )
    kept = entries.select("seq", strip(F.col("value")).alias("entry")).filter("entry <> ''")
    return kept.select("seq", *[c.alias(n) for n, c in L.parse(F.col("entry")).items()])


def write_lessons(lessons: DataFrame, path: str) -> None:
    """Append lessons to a markdown store in order of ``seq``."""
    fields = [F.col(c) for c in ("ts", "error_type", "pattern", "fix", "example_sql")]
    entry = F.concat(F.lit("\n"), L.to_markdown(*fields), F.lit("\n"))
    (
        lessons.orderBy("seq")
        .select(entry.alias("value"))
        .write.mode("append")
        .option("lineSep", L.SEPARATOR)
        .text(path)
    )


def read_step_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of all questions, one row each, steps in an array: from files ``<id>_log.json`` of one
    question each, and from what ``write_log_lines`` left in the same folder."""
    reader = spark.read.schema(LOG_SCHEMA)
    single = reader.option("multiLine", True).option("pathGlobFilter", "*_log.json").json(path)
    reader = spark.read.schema(LOG_SCHEMA)
    return single.unionByName(reader.option("pathGlobFilter", "part-*.json").json(path))


def write_step_logs(logs: DataFrame, path: str) -> None:
    """Logs as a Parquet table, for queries over many runs."""
    logs.write.mode("append").parquet(path)


def write_log_lines(logs: DataFrame, path: str) -> None:
    """Logs as JSON, one question per line, for ``read_step_logs``."""
    logs.write.mode("append").json(path)


def write_hard_failures(failures: DataFrame, path: str) -> None:
    failures.write.mode("append").partitionBy("failure_type").json(path)


def read_hard_failures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAILURE_SCHEMA).json(path)
