"""Question sets and grading standards, one JSON object per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.paths import or_empty, positioned

QUESTION_FIELDS = ["instance_id", "instruction", "question", "db_id", "external_knowledge"]
QUESTION_SCHEMA = ", ".join(f"{f} STRING" for f in QUESTION_FIELDS)


def normalise(raw: DataFrame) -> DataFrame:
    """Question text and defaults; ``pos`` tells the order, and a later duplicate wins."""
    kept = raw.groupBy("instance_id").agg(
        F.max_by(F.struct(*QUESTION_FIELDS[1:]), "pos").alias("q"), F.min("pos").alias("pos")
    )
    empty = F.lit("")
    return kept.select(
        "instance_id",
        F.coalesce("q.instruction", "q.question", empty).alias("nlq"),
        F.coalesce("q.db_id", empty).alias("db_id"),
        F.coalesce("q.external_knowledge", empty).alias("external_knowledge"),
        "pos",
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    lines = positioned(spark.read.text(path)).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", QUESTION_SCHEMA).alias("q"), "pos")
    return normalise(parsed.select("q.*", "pos"))


def choose(
    questions: DataFrame, limit: int | None = None, ids: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Explicit ids, else the first ``limit`` questions, else all."""
    if isinstance(ids, DataFrame):
        return questions.join(ids.select("instance_id"), "instance_id", "left_semi")
    if ids:
        return questions.filter(F.col("instance_id").isin(list(ids)))
    return questions.orderBy("pos").limit(limit) if limit else questions


def read_standards(spark: SparkSession, path: str) -> DataFrame:
    """Standards with ``condition_cols`` kept as written, and ``pos``, their place by the first
    line of an instance; its last line counts. No file means no standards."""
    lines = or_empty(
        spark, "value STRING, pos BIGINT", lambda: positioned(spark.read.text(path))
    )
    line = F.col("value")
    parsed = lines.filter(F.trim(line) != "").select(
        F.get_json_object(line, "$.instance_id").alias("instance_id"),
        F.get_json_object(line, "$.condition_cols").alias("condition_cols_raw"),
        F.coalesce(
            F.get_json_object(line, "$.ignore_order").try_cast("boolean"), F.lit(False)
        ).alias("ignore_order"),
        "pos",
    )
    last = F.max_by(F.struct("condition_cols_raw", "ignore_order"), "pos").alias("s")
    rows = parsed.groupBy("instance_id").agg(last, F.min("pos").alias("pos"))
    return rows.select("instance_id", "s.*", "pos")
