"""Prompt texts for many questions and attempts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.ordered import first_rows

# Section titles and layout of a prompt, and the opening line per shape.
DOCS_TITLE = "ADDITIONAL DOCUMENTATION:\n"
NO_LESSONS = "No learnings yet."
FIRST = "first"
REQUIREMENTS = "requirements"
EXECUTION = "execution"
OPENINGS = {
    FIRST: "Write a {dialect} SQL query to answer the question.",
    REQUIREMENTS: "Fix your SQL — it failed requirements.",
    EXECUTION: "Fix your SQL — it hit a {dialect} error.",
}
ANSWER_CUE = "Output <thinking> then ```sql:"


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), body)


def prompt_text(lessons: Column, dialect: str = "Spark") -> Column:
    """Prompt of one row. Columns: shape, ddl, docs, transcript, tree_text, nlq, and for
    retries previous_sql, attempt, failed_subtasks or error_type and error_message."""
    shape = F.col("shape")
    opening = F.lit(None).cast("string")
    for name, line in OPENINGS.items():
        opening = F.when(shape == name, line.format(dialect=dialect)).otherwise(opening)
    docs = F.when(F.col("docs") != "", F.concat(F.lit(DOCS_TITLE), F.col("docs"))).otherwise("")
    previous = F.when(
        shape != FIRST,
        F.format_string("PREVIOUS SQL (attempt %d):\n```\n%s\n```", "attempt", "previous_sql"),
    )
    trouble = F.when(
        shape == REQUIREMENTS, _section("FAILED SUBTASKS", F.col("failed_subtasks"))
    ).when(
        shape == EXECUTION, F.format_string("ERROR (%s): %s", "error_type", "error_message")
    )
    return F.concat_ws(
        "\n\n",
        opening,
        _section("SCHEMA", F.col("ddl")),
        docs,
        F.col("transcript"),
        _section("LEARNINGS", lessons),
        _section("SUBTASKS", F.col("tree_text")),
        F.concat(F.lit("QUESTION: "), F.col("nlq")),
        previous,
        trouble,
        F.lit(ANSWER_CUE),
    )


def load_context(
    questions: DataFrame, schemas: DataFrame, documents: DataFrame, docs_budget: int
) -> DataFrame:
    """Questions with schema text and document; '' where there is none.

    Documents get their table of contents and are cut before they are joined, so each text is
    prepared once however many questions name it. Questions without document get a key of
    their own, so that they do not meet in one task.
    """
    prepared = documents.select(
        F.col("name").alias("_document"),
        T.truncate(T.with_contents(F.col("content")), docs_budget).alias("docs"),
    )
    named = F.col("external_knowledge")
    document = F.when(named == "", F.concat(F.lit("\0"), "instance_id")).otherwise(named)
    return (
        questions.withColumn("_document", document)
        .join(schemas.select("db_id", "ddl"), "db_id", "left")
        .join(prepared, "_document", "left")
        .drop("_document")
        .withColumns(
            {"ddl": F.coalesce("ddl", F.lit("")), "docs": F.coalesce("docs", F.lit(""))}
        )
    )


def assemble(context: DataFrame, lessons: DataFrame, dialect: str = "Spark") -> DataFrame:
    """Adds ``prompt``; ``lessons`` is one row with the lessons text, '' for none."""
    text = lessons.scalar()
    shown = F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(NO_LESSONS)
    return context.withColumn("prompt", prompt_text(shown, dialect))


# Layout of an exploration transcript.
TRANSCRIPT_HEAD = "### Database Exploration Transcript\n\n"
CAP_NOTE = (
    "**System:** Automatically appended `LIMIT 5` to prevent context blowout.\n\n"
)
READY_NOTE = "**Agent:** READY (Exploration Complete)\n"
NO_ROWS = "Success. (0 rows returned)"
QUERY_ERROR = "Error executing query: "
LEAST_STEP = 20


def result_text(success: Column, n_rows: Column, rows_json: Column, message: Column) -> Column:
    """What a recon query returned, as shown in the transcript."""
    return (
        F.when(~success, F.concat(F.lit(QUERY_ERROR), F.coalesce(message, F.lit(""))))
        .when(F.coalesce(n_rows, F.lit(0)) == 0, NO_ROWS)
        .otherwise(rows_json)
    )


def step_block(sql: Column, capped: Column, result: Column, query_budget: int) -> Column:
    return F.concat(
        F.when(capped, CAP_NOTE).otherwise(""),
        F.lit("**Agent Recon Query:**\n```sql\n"),
        sql,
        F.lit("\n```\n\n**Database Result:**\n"),
        T.truncate(result, query_budget, T.QUERY_TRUNCATED),
        F.lit("\n\n"),
    )


def sample_rows(rows: DataFrame, group: str, order: list[str], columns: list[str], count: int = 5):
    """First rows of each group as a JSON array of records."""
    top = first_rows(rows.select(group, *order, *columns), [group], order, count)
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    ordered = F.sort_array(F.collect_list(F.struct("_rank", record.alias("r"))))
    return top.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.concat(
            F.lit("["), F.array_join(F.transform(ordered, lambda x: x.r), ", "), F.lit("]")
        ).alias("rows_json"),
    )
