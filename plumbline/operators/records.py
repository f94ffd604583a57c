"""Run records as tables: requirement scores, attempts, step durations, hard failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import answers as J
from plumbline.functions import errors as E
from plumbline.operators.ordered import previous_values

# Outcomes of a question, length of a recorded detail, name of the only detail
# of a failure that is no record, and retries per loop.
SUCCEEDED = "succeeded"
FAILED_REQUIREMENTS = "failed_requirements"
FAILED_EXECUTION = "failed_execution"
DETAIL_LENGTH = 500
ONLY_DETAIL = "value"
MAX_ATTEMPTS = 3
EXPLORER_PREFIX = "EXPLORER_"
EXPLORATION_ERROR = "exploration_syntax"
EMPTY_RESULT = "empty_result"
NULL_RESULT = "null_result"


def requirement_scores(checks: DataFrame) -> DataFrame:
    """Score of each requirement check; ``checks`` has ``answer`` and the subtask ``tree``.

    The score is the number of satisfied verdicts over the number of subtasks asked for, so
    missing verdicts lower it and repeated ones can push it past 1, which does not pass. An
    answer is one row, so nothing is shuffled.
    """
    parsed = F.col("_verdicts")
    total = F.size("tree")
    satisfied = F.size(F.filter(parsed, lambda v: J.is_true(v.satisfied)))
    score = F.when(parsed.isNull() | (total == 0), F.lit(0.0)).otherwise(
        F.try_divide(satisfied.cast("double"), total.cast("double"))
    )
    return (
        checks.withColumn("_verdicts", J.verdicts(F.col("answer")))
        .withColumns(
            {
                "score": F.round(score, 3),
                "passed": score == 1.0,
                "failed": J.failed_verdicts(parsed, F.col("tree")),
            }
        )
        .drop("_verdicts")
    )


def step_durations(steps: DataFrame, group: str, order: list[str], elapsed: str) -> DataFrame:
    """Time of each step from the running clock of its question; the first counts from 0."""
    before = previous_values(steps, [group], order, elapsed, "_before")
    duration = F.col(elapsed) - F.coalesce(F.col("_before"), F.lit(0))
    return before.withColumn("duration_ms", duration).drop("_before")


def step_totals(durations: DataFrame, step: str = "step") -> DataFrame:
    return durations.groupBy(step).agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("longest_ms"),
    )


def array_step_durations(logs: DataFrame) -> DataFrame:
    """The same for step logs with one row per question and its steps in an array."""
    steps = F.transform(
        "steps",
        lambda s, i: F.struct(
            (i + 1).alias("position"),
            s.step.alias("step"),
            (
                s.elapsed_ms
                - F.when(i > 0, F.get(F.col("steps"), i - 1).elapsed_ms).otherwise(0)
            ).alias("duration_ms"),
        ),
    )
    return logs.select("instance_id", F.inline(steps))


def attempt_outcomes(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Last attempt of each question decides its outcome.

    ``attempts``: instance_id, loop, success, error_type, the ``order`` columns, and
    ``elapsed_ms`` where the clock is known. Only one row per question and task is shuffled.
    """
    last = F.max_by(F.struct("loop", "success", "error_type"), F.struct(*order))
    outcome = (
        F.when(F.col("last.success") & (F.col("last.loop") == "execution"), SUCCEEDED)
        .when(F.col("last.loop") == "execution", FAILED_EXECUTION)
        .otherwise(FAILED_REQUIREMENTS)
    )
    clock = []
    if "elapsed_ms" in attempts.columns:
        clock = [F.min("elapsed_ms").alias("started_ms"), F.max("elapsed_ms").alias("ended_ms")]
    found = attempts.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), last.alias("last"), *clock
    )
    return found.select(
        "instance_id",
        "n_attempts",
        outcome.alias("outcome"),
        F.col("last.error_type").alias("last_error_type"),
        *(["started_ms", "ended_ms"] if clock else []),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Questions by outcome, and the time from the first start to the last end.

    ``outcomes`` may carry ``started_ms`` and ``ended_ms`` of each question.
    """

    def count(state: str) -> Column:
        return F.count_if(F.col("outcome") == state)

    timed = {"started_ms", "ended_ms"} <= set(outcomes.columns)
    elapsed = [(F.max("ended_ms") - F.min("started_ms")).alias("elapsed_ms")] if timed else []
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        count(SUCCEEDED).alias("succeeded"),
        count(FAILED_REQUIREMENTS).alias("failed_requirements"),
        count(FAILED_EXECUTION).alias("failed_execution"),
        *elapsed,
    )


def silent_failure(success: Column, n_rows: Column, n_values: Column, kind: Column) -> Column:
    """Error kind of an execution that also knows queries that ran but returned nothing."""
    return (
        F.when(~success, kind)
        .when(n_rows == 0, EMPTY_RESULT)
        .when(n_values == 0, NULL_RESULT)
        .otherwise(E.NO_ERROR)
    )


def hard_failures(failed: DataFrame, details: dict[str, Column] | Column) -> DataFrame:
    """Record of each question that used up its attempts; every detail is cut.

    ``failed``: instance_id, failure_type, ts. A plain text is the only detail of its record.
    """
    if isinstance(details, Column):
        details = {ONLY_DETAIL: details}
    pairs = [x for name, value in details.items() for x in (F.lit(name), value.cast("string"))]
    cut = F.transform_values(F.create_map(*pairs), lambda k, v: F.left(v, F.lit(DETAIL_LENGTH)))
    return failed.select(
        "instance_id", "failure_type", F.col("ts").cast("string").alias("timestamp"), cut.alias("details")
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per model; ``calls``: model, is_input, tokens."""
    tokens, is_input = F.col("tokens"), F.col("is_input")
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(F.when(is_input, tokens).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(is_input, 0).otherwise(tokens)).alias("output_tokens"),
    )


def lesson_candidates(
    executions: DataFrame, explorations: DataFrame, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Failures a lesson is drawn from: failed executions that were tried again (all but those of
    the last attempt), and every failed exploration query.

    ``executions``: instance_id, attempt, error_type, message, sql (error_type ``none`` for a
    success); ``explorations``: instance_id, success, message, sql.
    """
    message, sql = F.left("message", F.lit(DETAIL_LENGTH)), F.left("sql", F.lit(DETAIL_LENGTH))
    retried = executions.filter(
        (F.col("error_type") != E.NO_ERROR) & (F.col("attempt") < max_attempts)
    ).select("instance_id", "error_type", message.alias("message"), sql.alias("sql"))
    explored = explorations.filter(~F.col("success")).select(
        "instance_id",
        F.lit(EXPLORER_PREFIX + EXPLORATION_ERROR).alias("error_type"),
        message.alias("message"),
        sql.alias("sql"),
    )
    return retried.unionByName(explored)
