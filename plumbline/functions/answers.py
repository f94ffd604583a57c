"""Model answers that should hold JSON: unwrapping, parsing, defaults, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# Shapes of the two answers and the default texts.
SUBTASKS = "array<struct<id string, description string, parent_id string, level string>>"
VERDICTS = "array<struct<subtask_id string, satisfied variant, reason string>>"
LESSONS = "array<struct<error_type string, pattern string, fix string, example string>>"
PARSE_FAILURE = "Requirements checker parse failure"
NO_ID = "?"
NO_REASON = "no reason"
# JSON texts that count as no.
FALSE_TEXTS = ["false", "null", '""', "[]", "{}"]
ZERO = r"^-?0(\.0*)?([eE][+-]?\d+)?$"
NO_PARENT = ["", "0", "0.0", "false"]
LESSON_DEFAULTS = {
    "error_type": "other",
    "pattern": "Unknown pattern",
    "fix": "Review and adjust",
    "example": "",
}


def unfenced(answer: Column) -> Column:
    """Body of an answer that starts with a fence, up to the first line of three backticks.

    An answer that never closes its fence loses its last line, as its closing line would be.
    """
    body = strip(answer)
    rows = F.split(body, "\n")
    size = F.size(rows)
    marks = F.transform(rows, lambda line, i: (i > 0) & (strip(line) == "```"))
    closing = F.array_position(marks, F.lit(True))
    last = F.when(closing > 0, closing - 1).otherwise(size - 1)
    inner = F.slice(rows, F.lit(2), F.greatest(last - 1, F.lit(0)).cast("int"))
    return F.when(body.startswith("```"), strip(F.array_join(inner, "\n"))).otherwise(body)


def json_text(answer: Column) -> Column:
    """JSON text of an answer; an array wrapped in a JSON string is unwrapped once."""
    body = unfenced(answer)
    wrapped = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    return F.when(body.startswith('"'), F.get(wrapped, F.lit(0))).otherwise(body)


def _rows(answer: Column, shape: str) -> Column:
    """Parsed array, or NULL when the text is no JSON array."""
    text = json_text(answer)
    return F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, shape))


def is_true(value: Column) -> Column:
    """Whether a JSON value of any type counts as yes: not false, null, zero or empty."""
    text = F.to_json(value)
    return F.coalesce(~text.isin(FALSE_TEXTS) & ~text.rlike(ZERO), F.lit(False))


def subtasks(answer: Column) -> Column:
    """Subtask tree as the answer has it, NULL where it has none.

    Parsing is costly: keep the result as a column and pass that to the functions below.
    """
    return _rows(answer, SUBTASKS)


def usable_tree(parsed: Column, question: Column) -> Column:
    """The parsed tree with default levels.

    One element without id or description, or no array at all, and the whole answer is
    replaced by a single subtask: the question itself.
    """
    tree = F.transform(
        parsed,
        lambda s: F.struct(
            s.id.alias("id"),
            s.description.alias("description"),
            s.parent_id.alias("parent_id"),
            F.coalesce(s.level.try_cast("double").cast("int"), F.lit(0)).alias("level"),
        ),
    )
    whole = F.forall(parsed, lambda s: s.id.isNotNull() & s.description.isNotNull())
    fallback = F.array(
        F.struct(
            F.lit("1").alias("id"),
            question.alias("description"),
            F.lit(None).cast("string").alias("parent_id"),
            F.lit(0).alias("level"),
        )
    )
    return F.when(F.coalesce(whole, F.lit(False)), tree).otherwise(fallback)


def tree_text(tree: Column) -> Column:
    """Indented text of a subtask tree, one line per subtask."""

    def line(s: Column) -> Column:
        child = F.when(
            ~F.coalesce(s.parent_id, F.lit("")).isin(NO_PARENT),
            F.format_string(" (child of #%s)", s.parent_id),
        ).otherwise("")
        return F.concat(
            F.repeat(F.lit("  "), s.level), F.format_string("#%s: ", s.id), s.description, child
        )

    return F.array_join(F.transform(tree, line), "\n")


def verdicts(answer: Column) -> Column:
    return _rows(answer, VERDICTS)


def failed_verdicts(parsed: Column, tree: Column) -> Column:
    """Verdicts not satisfied; an answer that cannot be read fails every subtask."""
    failed = F.transform(
        F.filter(parsed, lambda v: ~is_true(v.satisfied)),
        lambda v: F.struct(
            v.subtask_id.alias("subtask_id"), F.lit(False).alias("satisfied"), v.reason.alias("reason")
        ),
    )
    all_failed = F.transform(
        tree,
        lambda s: F.struct(
            s.id.cast("string").alias("subtask_id"),
            F.lit(False).alias("satisfied"),
            F.lit(PARSE_FAILURE).alias("reason"),
        ),
    )
    return F.when(parsed.isNull(), all_failed).otherwise(failed)


def bullets(failed: Column) -> Column:
    """``- Subtask #id: reason`` lines, in the order of the verdicts."""
    return F.array_join(
        F.transform(
            failed,
            lambda v: F.concat(
                F.lit("- Subtask #"),
                F.coalesce(v.subtask_id.cast("string"), F.lit(NO_ID)),
                F.lit(": "),
                F.coalesce(v.reason, F.lit(NO_REASON)),
            ),
        ),
        "\n",
    )


def lessons(answer: Column) -> Column:
    """Lessons of a taxonomy answer with defaults for absent fields; unreadable -> empty."""
    shape = F.transform(
        _rows(answer, LESSONS),
        lambda e: F.struct(
            *[F.coalesce(e[k], F.lit(v)).alias(k) for k, v in LESSON_DEFAULTS.items()]
        ),
    )
    return F.coalesce(shape, F.array().cast(LESSONS))
