"""Cleaning, guarding and judging SQL texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import strip

# The fenced-block pattern, the thinking tag, the read-only verbs, the
# row cap put on samples, and the seconds of the complexity estimate.
FENCE = r"(?s)```(?:sql)?\s*\n?(.*?)\n?\s*```"
FENCE_ANY_CASE = r"(?is)```(?:sql)?\s*\n?(.*?)\n?\s*```"
THINKING = r"(?is)<thinking>.*?</thinking>"
READ_ONLY_VERBS = ["select", "show", "describe", "desc"]
ROW_CAP = r"(?i)\blimit\s+\d+"
SAMPLE_ROWS = 5
BASE_SECONDS = 60
MAX_SECONDS = 300
WILDCARD_SECONDS = 60
RANKING_SECONDS = 30
JOIN_SECONDS = 20
FREE_JOINS = 2
UNION_SECONDS = 15
RANKING_CALLS = ["RANK()", "ROW_NUMBER()", "DENSE_RANK()"]


def from_answer(answer: Column) -> Column:
    """SQL in a model answer: the first fenced block, else the text without thinking tags."""
    body = strip(answer)
    fenced = strip(F.regexp_extract(body, FENCE_ANY_CASE, 1))
    bare = strip(F.regexp_replace(body, THINKING, ""))
    return F.when(body.rlike(FENCE_ANY_CASE), fenced).otherwise(bare)


def runnable(sql: Column) -> Column:
    """One statement to run: unfenced, without trailing ``;``, the part before any other ``;``."""
    body = strip(sql)
    unfenced = F.when(body.rlike(FENCE), strip(F.regexp_extract(body, FENCE, 1))).otherwise(body)
    ended = F.rtrim(unfenced, F.lit("; \n\t"))
    first = strip(F.split_part(ended, F.lit(";"), F.lit(1)))
    return F.when(ended.contains(";") & (first != ""), first).otherwise(ended)


def first_word(sql: Column) -> Column:
    return F.lower(F.regexp_extract(strip(sql), r"^(\S+)", 1))


def is_read_only(sql: Column) -> Column:
    return first_word(sql).isin(READ_ONLY_VERBS)


def is_uncapped_select(sql: Column) -> Column:
    body = strip(sql)
    return F.lower(body).startswith("select") & ~body.rlike(ROW_CAP)


def capped(sql: Column) -> Column:
    """A SELECT without any LIMIT gets one; other statements stay as they are."""
    body = strip(sql)
    cut = F.concat(F.rtrim(body, F.lit(";")), F.lit(f"\nLIMIT {SAMPLE_ROWS}"))
    return F.when(is_uncapped_select(sql), cut).otherwise(body)


def _occurrences(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(word))


def has_ranking(sql: Column) -> Column:
    upper = F.upper(sql)
    flag = F.lit(False)
    for call in RANKING_CALLS:
        flag = flag | upper.contains(call)
    return flag


def estimated_seconds(
    sql: Column, base: int = BASE_SECONDS, cap: int = MAX_SECONDS
) -> Column:
    """Seconds a statement may need, judged from the raw text: at least ``base``, at most
    ``cap``."""
    wildcard = F.when(sql.contains("LIKE '%"), WILDCARD_SECONDS).otherwise(0)
    ranking = F.when(has_ranking(sql), RANKING_SECONDS).otherwise(0)
    joins = F.greatest(_occurrences(sql, "JOIN") - FREE_JOINS, F.lit(0)) * JOIN_SECONDS
    unions = _occurrences(F.upper(sql), "UNION ALL") * UNION_SECONDS
    total = F.lit(base) + wildcard + ranking + joins + unions
    return F.least(total, F.lit(cap)).cast("int")
