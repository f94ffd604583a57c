"""The store of lessons: text form, parsing, and an append that keeps patterns unique.

``lessons``: seq (order of writing), ts, error_type, pattern, fix, example_sql
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normal_pattern, strip

# Layout of a lesson and what separates two of them; fallbacks of a lesson.
ENTRY = "## [%s] [%s]\n**Pattern:** %s\n**Fix:** %s\n**Example:** `%s`"
SEPARATOR = "\n---\n"
HEAD = r"(?m)^## \[([^\]]*)\] \[([^\]]*)\]"
PATTERN = r"(?ms)^\*\*Pattern:\*\*(.*?)(?=^\*\*Fix:\*\*|\z)"
FIX = r"(?ms)^\*\*Fix:\*\*(.*?)(?=^\*\*Example:\*\*|\z)"
EXAMPLE = r"(?s)\*\*Example:\*\* `(.*)`\s*$"
RAW_PATTERN = "Raw error: "
RAW_LENGTH = 100
RAW_FIX = "Review the {dialect} error and adjust SQL accordingly"
DEFAULT_FIX = "Review error and adjust SQL"


def to_markdown(ts: Column, error_type: Column, pattern: Column, fix: Column, sql: Column):
    return F.format_string(ENTRY, ts, error_type, pattern, fix, sql)


def parse(entry: Column) -> dict[str, Column]:
    """Fields of one entry in its text form."""
    return {
        "ts": F.regexp_extract(entry, HEAD, 1),
        "error_type": F.regexp_extract(entry, HEAD, 2),
        "pattern": strip(F.regexp_extract(entry, PATTERN, 1)),
        "fix": strip(F.regexp_extract(entry, FIX, 1)),
        "example_sql": F.regexp_extract(entry, EXAMPLE, 1),
    }


def from_answer(answer: Column, error_type: Column, message: Column, dialect: str = "Spark"):
    """Lesson a model wrote for an error, as a struct; the raw error where it wrote none."""
    text = F.from_json(
        answer, "struct<error_type string, pattern string, fix string, example string>"
    )
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json(answer)).startswith("OBJECT"), F.lit(False))
    short = F.left(message, F.lit(RAW_LENGTH))
    return F.when(
        readable,
        F.struct(
            F.coalesce(text.error_type, error_type).alias("error_type"),
            F.coalesce(text.pattern, short).alias("pattern"),
            F.coalesce(text.fix, F.lit(DEFAULT_FIX)).alias("fix"),
            F.coalesce(text.example, F.lit("")).alias("example_sql"),
        ),
    ).otherwise(
        F.struct(
            error_type.alias("error_type"),
            F.concat(F.lit(RAW_PATTERN), short).alias("pattern"),
            F.lit(RAW_FIX.format(dialect=dialect)).alias("fix"),
            F.lit("").alias("example_sql"),
        )
    )


def with_norm(lessons: DataFrame) -> DataFrame:
    """Adds ``norm``, by which patterns are told apart: the first line, '' where there is none."""
    first = F.split_part(strip(F.coalesce("pattern", F.lit(""))), F.lit("\n"), F.lit(1))
    return lessons.withColumn("norm", normal_pattern(first))


def new_lessons(incoming: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Incoming lessons whose pattern is not stored yet, the first of each pattern.

    Copies are reduced before the shuffle, so a pattern that a third of all lessons share is
    one row per task when it meets the store.
    """
    rows = with_norm(incoming)
    kept = rows.groupBy("norm").agg(
        F.min_by(F.struct(*incoming.columns), "seq").alias("_first")
    )
    if stored is not None:
        known = stored.select("norm") if "norm" in stored.columns else with_norm(stored).select("norm")
        kept = kept.join(known, "norm", "left_anti")
    return kept.select("_first.*", "norm")


def latest(lessons: DataFrame, count: int) -> DataFrame:
    """The last ``count`` lessons written; 0 means all."""
    if count <= 0:
        return lessons
    return lessons.orderBy(F.col("seq").desc()).limit(count)


def lessons_text(lessons: DataFrame, count: int) -> DataFrame:
    """The last lessons as one text in order of writing, one row; '' when there are none."""
    entry = to_markdown(*[F.col(c) for c in ("ts", "error_type", "pattern", "fix", "example_sql")])
    rows = latest(lessons, count).select("seq", entry.alias("entry"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "entry")))
    return rows.agg(
        F.array_join(F.transform(ordered, lambda e: strip(e.entry)), SEPARATOR).alias("lessons")
    )


def kind_counts(lessons: DataFrame) -> DataFrame:
    return lessons.groupBy("error_type").agg(F.count(F.lit(1)).alias("n_lessons"))
