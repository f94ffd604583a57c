"""Registered queries over run records and lessons, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import answers as J
from plumbline.functions import errors as E
from plumbline.functions import sql_text as S
from plumbline.functions import text as T
from plumbline.functions.text import BLANKS
from plumbline.operators import lessons as L
from plumbline.operators import prompts as P
from plumbline.operators import records as R
from plumbline.operators.catalogue import budgeted_text
from plumbline.session import fresh_path
from plumbline.sources.tables import derive, load, plain, spread
from plumbline.streaming import lessons as stream

_BLANKS_SQL = "'" + BLANKS + "'"


def portable(text: str) -> str:
    """Oracle form of SQL whose braces are doubled for the table placeholders."""
    return plain(text).replace("{{", "{").replace("}}", "}")


# ------------------------------------------------------------------- requirement checks

# One check per order: three subtasks, and an answer with all, some, repeated or no verdicts.
CHECKS = """
select o_orderkey as check_id, 3 as n_subtasks,
  case o_orderkey % 8
    when 0 then '[{{"subtask_id": 1, "satisfied": true}}, {{"subtask_id": 2, "satisfied": true}}, '
                || '{{"subtask_id": 3, "satisfied": true}}]'
    when 1 then '[{{"subtask_id": 1, "satisfied": true}}, {{"subtask_id": 2, "satisfied": false, '
                || '"reason": "no ' || o_orderpriority || '"}}]'
    when 2 then 'I cannot judge this'
    when 3 then '[]'
    when 4 then '[{{"satisfied": false}}, {{"subtask_id": 2, "satisfied": true}}, '
                || '{{"subtask_id": 9, "reason": "unknown"}}]'
    when 5 then '```json
[{{"subtask_id": 1, "satisfied": true}}, {{"subtask_id": 1, "satisfied": true}},
 {{"subtask_id": 2, "satisfied": true}}, {{"subtask_id": 3, "satisfied": true}}]
```'
    when 6 then '[{{"subtask_id": 1, "satisfied": true}}, {{"subtask_id": 2, "satisfied": true}}]'
    else '{{"subtask_id": 1, "satisfied": true}}'
  end as answer
from {orders}
"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.transform(
        F.sequence(F.lit(1), F.col("n_subtasks")),
        lambda i: F.struct(
            i.alias("id"),
            F.format_string("step %d", i).alias("description"),
            F.lit(None).cast("int").alias("parent_id"),
            F.lit(0).alias("level"),
        ),
    )
    checks = spread(derive(spark, sf_dir, CHECKS))
    return R.requirement_scores(checks.withColumn("tree", tree))


def requirements_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).select("check_id", "score", "passed")


def failed_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checks(spark, sf_dir).select(
        "check_id",
        F.size("failed").cast("bigint").alias("n_failed"),
        J.bullets(F.col("failed")).alias("failed_text"),
    )


_VERDICTS_SQL = portable(
    f"""
c as (select check_id, n_subtasks,
        case when starts_with(answer, '```') then
          regexp_extract(answer, '(?s)^```[^\\n]*\\n(.*)\\n```$', 1) else answer end as body
      from ({CHECKS})),
p as (select check_id, n_subtasks,
        case when json_valid(body) and json_type(body) = 'ARRAY'
             then cast(body as json[]) end as verdicts from c),
v as (select check_id, n_subtasks, verdicts is null as unreadable,
        list_filter(verdicts, lambda x: coalesce(cast(json_extract(x, '$.satisfied') as boolean), false)) as good,
        list_filter(verdicts, lambda x: not coalesce(cast(json_extract(x, '$.satisfied') as boolean), false)) as bad
      from p)
"""
)
REQUIREMENTS_SCORE_SQL = f"""
with {_VERDICTS_SQL}
select check_id, coalesce(round(len(good) / n_subtasks, 3), 0) as score,
  coalesce(len(good) = n_subtasks, false) as passed
from v
"""
FAILED_SUBTASKS_SQL = f"""
with {_VERDICTS_SQL}
select check_id, case when unreadable then n_subtasks else len(bad) end as n_failed,
  array_to_string(case when unreadable
    then ['- Subtask #1: Requirements checker parse failure',
          '- Subtask #2: Requirements checker parse failure',
          '- Subtask #3: Requirements checker parse failure']
    else list_transform(bad, lambda x: '- Subtask #' || coalesce(json_extract_string(x, '$.subtask_id'), '?')
         || ': ' || coalesce(json_extract_string(x, '$.reason'), 'no reason')) end, chr(10)) as failed_text
from v
"""

# ------------------------------------------------------------------------ subtask trees

# One answer per conversation turn: a tree, a fenced or double-encoded one, or something that
# cannot be used, so that the question itself becomes the only subtask.
TREES = """
select conv_id, turn, question,
  case k when 0 then tree when 1 then '```json
' || tree || '
```
trailing words'
    when 2 then '"' || replace(tree, '"', chr(92) || '"') || '"'
    when 3 then 'no tree'
    when 4 then '[{{"id": 1, "description": "only"}}, {{"description": "no id"}}]'
    when 5 then '[{{"id": 1}}]'
    else '[]' end as answer
from (select conv_id, turn, replace(text, '
', ' ') as question, (conv_id + turn) % 7 as k,
        '[{{"id": 1, "description": "turn ' || cast(turn as string) || '", "parent_id": null, "level": 0}}, '
        || '{{"id": 2, "description": "' || role || '", "parent_id": 1, "level": 1}}, '
        || '{{"id": 3, "description": "count", "parent_id": 2, "level": 2}}, '
        || '{{"id": 4, "description": "last", "parent_id": 0}}]' as tree
      from {conversations})
"""


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = derive(spark, sf_dir, TREES).withColumn("parsed", J.subtasks(F.col("answer")))
    return parsed.withColumn("tree", J.usable_tree(F.col("parsed"), F.col("question")))


def subtask_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trees(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.size("tree").cast("bigint").alias("n_subtasks"),
        J.tree_text(F.col("tree")).alias("tree_text"),
    )


_TREE_CTES = portable(
    f"""
a as (select conv_id, turn, question,
        case when starts_with(answer, '```')
               then regexp_extract(answer, '(?s)^```[^\\n]*\\n(.*?)\\n```\\n', 1)
             when starts_with(answer, '"') then cast(answer as json) ->> '$'
             else answer end as body
      from ({TREES})),
b as (select *, case when json_valid(body) and json_type(body) = 'ARRAY'
                     then cast(body as json[]) end as items from a),
t as (select *, coalesce(items is not null and len(list_filter(items,
          lambda x: json_extract_string(x, '$.id') is null
               or json_extract_string(x, '$.description') is null)) = 0, false) as usable
      from b),
trees as (select conv_id, turn, question,
  case when usable then len(items) else 1 end as n_subtasks,
  case when not usable then '#1: ' || question
  else array_to_string(list_transform(items, lambda x:
    repeat('  ', coalesce(cast(json_extract(x, '$.level') as bigint), 0))
    || '#' || json_extract_string(x, '$.id') || ': ' || json_extract_string(x, '$.description')
    || case when coalesce(cast(json_extract_string(x, '$.parent_id') as bigint), 0) <> 0
            then ' (child of #' || json_extract_string(x, '$.parent_id') || ')' else '' end),
    chr(10)) end as tree_text
from t)
"""
)
SUBTASK_TREE_TEXT_SQL = (
    f"with {_TREE_CTES} select conv_id, turn, n_subtasks, tree_text from trees"
)

# ------------------------------------------------------------------------------ lessons

# A lesson per document; the text is its pattern, brought onto one line. Copies of documents
# are copies of patterns, half of them in other case or with blanks around.
LESSONS = """
select doc_id as seq, '2024-01-0' || cast(doc_id % 9 + 1 as string) || ' 10:00' as ts,
       case doc_id % 5 when 0 then 'syntax' when 1 then 'other' when 2 then 'EXPLORER_syntax'
            when 3 then 'empty_result' else 'runtime' end as error_type,
       case when doc_id % 2 = 1 then '  ' || lower(replace(text, '
', ' ')) || '	' else replace(text, '
', ' ') end as pattern,
       'use ' || lang as fix, 'SELECT ''' || source || '''' as example_sql
from {documents}
"""


def _lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(derive(spark, sf_dir, LESSONS))


def _entry():
    return L.to_markdown(*[F.col(c) for c in ("ts", "error_type", "pattern", "fix", "example_sql")])


def lessons_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lessons written to their text form and read back."""
    entries = _lessons(spark, sf_dir).select("seq", _entry().alias("entry"))
    return entries.select(
        "seq",
        F.length("entry").cast("bigint").alias("n_chars"),
        *[c.alias(n) for n, c in L.parse(F.col("entry")).items()],
    )


LESSONS_PARSE_SQL = plain(
    f"""
select seq, length('## [' || ts || '] [' || error_type || ']' || chr(10) || '**Pattern:** ' || pattern
    || chr(10) || '**Fix:** ' || fix || chr(10) || '**Example:** `' || example_sql || '`') as n_chars,
  ts, error_type, trim(pattern, {_BLANKS_SQL}) as pattern, fix, example_sql
from ({LESSONS})
"""
)


def lessons_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 lessons as the text that goes into a prompt."""
    return L.lessons_text(_lessons(spark, sf_dir), 40)


_ENTRY_SQL = """'## [' || ts || '] [' || error_type || ']' || chr(10) || '**Pattern:** ' || pattern
  || chr(10) || '**Fix:** ' || fix || chr(10) || '**Example:** `' || example_sql || '`'"""
_LESSONS_TEXT_SQL = plain(
    f"""select string_agg({_ENTRY_SQL}, chr(10) || '---' || chr(10) order by seq) as lessons
from (select * from ({LESSONS}) order by seq desc limit 40)"""
)
LESSONS_LATEST_SQL = _LESSONS_TEXT_SQL

# Lessons of the first source are stored already; the others arrive.
_STORED = "error_type = 'syntax'"


def lessons_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lessons(spark, sf_dir)
    fresh = L.new_lessons(rows.filter(f"NOT ({_STORED})"), rows.filter(_STORED))
    return fresh.select("seq", "error_type", "norm")


_DEDUP_CTES = plain(
    f"""
l as (select *, lower(trim(pattern, {_BLANKS_SQL})) as norm from ({LESSONS})),
stored as (select distinct norm from l where {_STORED}),
fresh as (select norm, min(seq) as seq, arg_min(error_type, seq) as error_type from l
          where not ({_STORED}) and norm not in (select norm from stored) group by norm)
"""
)
LESSONS_DEDUP_SQL = f"with {_DEDUP_CTES} select seq, error_type, norm from fresh"


def lessons_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lessons as files through the stream into an empty store: the stored ones
    first, and after them the others, which the stream picks up where it stopped."""
    source, store = fresh_path(spark, "lesson-files"), fresh_path(spark, "lesson-store")
    progress = fresh_path(spark, "lesson-progress")
    rows = _lessons(spark, sf_dir)
    for arriving in (rows.filter(_STORED), rows.filter(f"NOT ({_STORED})")):
        arriving.write.mode("append").json(source)
        stream.start(spark, source, store, progress).awaitTermination()
    return stream.read_store(spark, store).select("seq", "error_type", "norm")


LESSONS_STREAM_SQL = plain(
    f"""with {_DEDUP_CTES}
select seq, error_type, norm from fresh
union all
select min(seq), arg_min(error_type, seq), norm from l where {_STORED} group by norm"""
)


def lesson_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kind_counts(L.new_lessons(_lessons(spark, sf_dir), None))


LESSON_KINDS_SQL = plain(
    f"""
select error_type, count(*) as n_lessons
from (select arg_min(error_type, seq) as error_type from (
        select *, lower(trim(pattern, {_BLANKS_SQL})) as norm from ({LESSONS})) group by norm)
group by error_type
"""
)

# What a model wrote for each error: a lesson, a lesson with gaps, or nothing that parses.
LESSON_ANSWERS = """
select event_id, 'syntax' as error_type, repeat(event_type || ' failed; ', 20) as message,
  case event_id % 4
    when 0 then '{{"error_type": "schema_error", "pattern": "p' || cast(event_id as string)
                || '", "fix": "f", "example": "SELECT 1"}}'
    when 1 then '{{"fix": "only a fix"}}'
    when 2 then 'not json'
    else '{{}}' end as answer
from {events}
"""


def lessons_from_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lesson = L.from_answer(F.col("answer"), F.col("error_type"), F.col("message"))
    return derive(spark, sf_dir, LESSON_ANSWERS).select("event_id", lesson.alias("l")).select(
        "event_id", "l.*"
    )


LESSONS_FROM_ERRORS_SQL = portable(
    f"""
with a as ({LESSON_ANSWERS}),
j as (select event_id, error_type, message, case when json_valid(answer) then answer end as j from a)
select event_id,
  coalesce(json_extract_string(j, '$.error_type'), error_type) as error_type,
  case when j is null then 'Raw error: ' || left(message, 100)
       else coalesce(json_extract_string(j, '$.pattern'), left(message, 100)) end as pattern,
  case when j is null then 'Review the Spark error and adjust SQL accordingly'
       else coalesce(json_extract_string(j, '$.fix'), 'Review error and adjust SQL') end as fix,
  coalesce(json_extract_string(j, '$.example'), '') as example_sql
from j
"""
)

# Answers that hold several lessons, with gaps, wrapped, or useless.
TAXONOMY = """
select conv_id, turn, case (conv_id + turn) % 4
    when 0 then '[{{"error_type": "wrong_join", "pattern": "turn ' || cast(turn as string)
                || '", "fix": "f"}}, {{"example": "SELECT 1"}}]'
    when 1 then '```json
[{{"pattern": "' || role || '", "fix": "g", "example": "e"}}]
```'
    when 2 then 'nothing found'
    else '[]' end as answer
from {conversations}
"""


def taxonomy_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lesson in the answers, absent fields filled with their defaults."""
    lessons = derive(spark, sf_dir, TAXONOMY).withColumn("lessons", J.lessons(F.col("answer")))
    return lessons.select("conv_id", "turn", F.inline("lessons"))


TAXONOMY_LESSONS_SQL = portable(
    f"""
with a as (select conv_id, turn, case when starts_with(answer, '```')
             then regexp_extract(answer, '(?s)^```[^\n]*\n(.*)\n```$', 1) else answer end as body
           from ({TAXONOMY})),
e as (select conv_id, turn, unnest(cast(body as json[])) as e from a where json_valid(body))
select conv_id, turn, coalesce(json_extract_string(e, '$.error_type'), 'other') as error_type,
  coalesce(json_extract_string(e, '$.pattern'), 'Unknown pattern') as pattern,
  coalesce(json_extract_string(e, '$.fix'), 'Review and adjust') as fix,
  coalesce(json_extract_string(e, '$.example'), '') as example
from e
"""
)

# --------------------------------------------------------------------- steps and attempts

# A user is a question, its events are logged steps; the clock runs from the first of January.
_CLOCK_START = "2024-01-01"


def _clock(ts):
    start = F.lit(_CLOCK_START).cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", start, ts.cast("timestamp_ntz"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("instance_id"),
        "event_id",
        F.col("event_type").alias("step"),
        _clock(F.col("ts")).alias("elapsed_ms"),
    )


def step_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _steps(spark, sf_dir)
    found = R.step_durations(steps, "instance_id", ["elapsed_ms", "event_id"], "elapsed_ms")
    return found.select("instance_id", "event_id", "step", "duration_ms")


def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.step_totals(step_durations(spark, sf_dir))


_DURATIONS_SQL = f"""
s as (select user_id as instance_id, event_id, event_type as step,
        date_diff('millisecond', timestamp '{_CLOCK_START}', ts) as elapsed_ms from events),
d as (select instance_id, event_id, step, elapsed_ms - coalesce(lag(elapsed_ms) over
        (partition by instance_id order by elapsed_ms, event_id), 0) as duration_ms from s)
"""
STEP_DURATIONS_SQL = f"with {_DURATIONS_SQL} select * from d"
STEP_TOTALS_SQL = f"""with {_DURATIONS_SQL}
select step, count(*) as n_steps, cast(sum(duration_ms) as bigint) as total_ms,
  max(duration_ms) as longest_ms from d group by step"""

# Attempts of a question: the events of a user on one day. Purchases end an execution well,
# errors badly; views are requirement checks. Result sizes are told by the event.
ATTEMPTS = """
select cast(user_id as string) || '/' || substr(cast(ts as string), 1, 10) as instance_id,
       event_id, cast(event_id % 4 as int) as attempt, cast(ts as string) as ts,
       case when event_type in ('view', 'signup') then 'requirements' else 'execution' end as loop_name,
       event_type <> 'error' as success,
       case when event_type = 'error' then 'Numeric value ' || cast(user_id as string)
            else '' end as message,
       repeat('SELECT ' || event_type || ' FROM t; ', cast(event_id % 40 as int)) as sql,
       event_id % 6 as n_rows, event_id % 12 as n_values
from {events}
"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    success = F.col("success")
    kind = R.silent_failure(
        success,
        F.col("n_rows"),
        F.col("n_values"),
        E.execution_kind(success, F.col("message")),
    )
    attempts = derive(spark, sf_dir, ATTEMPTS).withColumnRenamed("loop_name", "loop")
    return attempts.withColumn("error_type", kind).withColumn(
        "success", F.col("error_type") == E.NO_ERROR
    )


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = _attempts(spark, sf_dir).withColumn("elapsed_ms", _clock(F.col("ts")))
    return R.attempt_outcomes(timed, ["event_id"])


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_summary(attempt_outcomes(spark, sf_dir))


_ATTEMPTS_CTES = plain(
    f"""
raw as ({ATTEMPTS}),
att as (select * replace (error_type = 'none' as success) from (
  select *, case when not success then 'runtime' when n_rows = 0 then 'empty_result'
                 when n_values = 0 then 'null_result' else 'none' end as error_type from raw)),
last as (select instance_id, count(*) as n_attempts, max(event_id) as event_id,
           min(date_diff('millisecond', timestamp '{_CLOCK_START}', cast(ts as timestamp))) as started_ms,
           max(date_diff('millisecond', timestamp '{_CLOCK_START}', cast(ts as timestamp))) as ended_ms
         from att group by instance_id),
outcomes as (
  select last.instance_id, n_attempts, started_ms, ended_ms,
    case when loop_name = 'execution' and success then 'succeeded'
         when loop_name = 'execution' then 'failed_execution' else 'failed_requirements' end as outcome,
    error_type as last_error_type, att.*
  from last join att using (event_id))
"""
)
ATTEMPT_OUTCOMES_SQL = f"""with {_ATTEMPTS_CTES}
select instance_id, n_attempts, outcome, last_error_type, started_ms, ended_ms from outcomes"""
RUN_SUMMARY_SQL = f"""with {_ATTEMPTS_CTES}
select count(*) as processed, count(*) filter (outcome = 'succeeded') as succeeded,
  count(*) filter (outcome = 'failed_requirements') as failed_requirements,
  count(*) filter (outcome = 'failed_execution') as failed_execution,
  max(ended_ms) - min(started_ms) as elapsed_ms
from outcomes"""


def hard_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose last attempt failed, with the cut details of that attempt."""
    attempts = _attempts(spark, sf_dir)
    last = attempts.groupBy("instance_id").agg(
        F.max_by(F.struct("loop", "success", "error_type", "message", "sql", "ts"), "event_id").alias("l")
    )
    failed = last.select("instance_id", "l.*").filter("NOT success")
    records = R.hard_failures(
        failed.withColumn("failure_type", F.col("loop")),
        {"error_type": F.col("error_type"), "error_message": F.col("message"), "sql": F.col("sql")},
    )
    return records.select(
        "instance_id",
        "failure_type",
        F.left("timestamp", F.lit(19)).alias("timestamp"),
        *[F.col("details")[k].alias(k) for k in ("error_type", "error_message", "sql")],
    )


HARD_FAILURES_SQL = f"""with {_ATTEMPTS_CTES}
select instance_id, loop_name as failure_type, left(ts, 19) as timestamp, error_type,
  left(message, 500) as error_message, left(sql, 500) as sql
from outcomes where not success"""


def lesson_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _attempts(spark, sf_dir)
    executions = attempts.filter("loop = 'execution'")
    explorations = attempts.filter("loop = 'requirements'")
    return R.lesson_candidates(executions, explorations)


LESSON_CANDIDATES_SQL = f"""with {_ATTEMPTS_CTES}
select instance_id, error_type, left(message, 500) as message, left(sql, 500) as sql
from att where loop_name = 'execution' and error_type <> 'none' and attempt < 3
union all
select instance_id, 'EXPLORER_exploration_syntax', left(message, 500), left(sql, 500)
from att where loop_name = 'requirements' and not success"""


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a conversation stand for its tokens; answers are output."""
    calls = load(spark, sf_dir, "conversations").select(
        F.format_string("model_%d", F.col("conv_id") % 3).alias("model"),
        (F.col("role") != "assistant").alias("is_input"),
        F.length("text").cast("bigint").alias("tokens"),
    )
    return R.token_usage(calls)


TOKEN_USAGE_SQL = """
select 'model_' || conv_id % 3 as model, count(*) as n_calls,
  cast(sum(case when role <> 'assistant' then length(text) else 0 end) as bigint) as input_tokens,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as output_tokens
from conversations group by 1
"""

# ------------------------------------------------------------------------ transcripts

# Recon steps of a user: each event ran a statement; some failed, some returned no rows.
RECON = """
select user_id, event_id,
       'SELECT ' || event_type || ' FROM t' || case when event_id % 3 = 0 then '' else ' LIMIT 9' end
         as sql,
       event_id % 7 <> 3 as success, event_id % 5 as n_rows,
       'invalid identifier ' || event_type as message,
       '[' || repeat('{{"k": ' || cast(event_id as string) || '}}, ', cast(event_id % 90 as int)) || ']'
         as rows_json
from {events}
"""
QUERY_BUDGET = 300
TRANSCRIPT_BUDGET = 1500


def transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript per user: its recon statements with their results, within the budgets."""
    sql = F.col("sql")
    result = P.result_text(F.col("success"), F.col("n_rows"), F.col("rows_json"), F.col("message"))
    block = P.step_block(S.capped(sql), S.is_uncapped_select(sql), result, QUERY_BUDGET)
    steps = derive(spark, sf_dir, RECON).select("user_id", "event_id", block.alias("block"))
    room = TRANSCRIPT_BUDGET - len(P.TRANSCRIPT_HEAD)
    texts = budgeted_text(steps, "user_id", "event_id", "block", room)
    whole = F.concat(F.lit(P.TRANSCRIPT_HEAD), F.col("head"))
    return texts.select(
        "user_id", T.truncate(whole, TRANSCRIPT_BUDGET, T.TRANSCRIPT_TRUNCATED).alias("transcript")
    )


TRANSCRIPT_TEXT_SQL = portable(
    f"""
with r as ({RECON}),
x as (select *, case when not success then 'Error executing query: ' || message
                     when n_rows = 0 then 'Success. (0 rows returned)' else rows_json end as result,
        not regexp_matches(sql, '(?i)\\blimit\\s+\\d+') as bare from r),
b as (select user_id, event_id,
  case when bare then '**System:** Automatically appended `LIMIT 5` to prevent context blowout.'
       || chr(10) || chr(10) else '' end
  || '**Agent Recon Query:**' || chr(10) || '```sql' || chr(10) || sql
  || case when bare then chr(10) || 'LIMIT 5' else '' end || chr(10) || '```' || chr(10) || chr(10)
  || '**Database Result:**' || chr(10)
  || case when length(result) > {QUERY_BUDGET} then left(result, {QUERY_BUDGET}) || chr(10)
     || '... [SYSTEM WARNING: Result truncated. Rewrite your query to be more targeted.]'
     else result end || chr(10) || chr(10) as block from x),
w as (select user_id, '### Database Exploration Transcript' || chr(10) || chr(10)
        || string_agg(block, '' order by event_id) as t from b group by user_id)
select user_id, case when length(t) > {TRANSCRIPT_BUDGET} then left(t, {TRANSCRIPT_BUDGET})
  || chr(10) || '... (exploration transcript truncated)' || chr(10) else t end as transcript
from w
"""
)


def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five orders of each customer as JSON records."""
    orders = load(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    return P.sample_rows(orders, "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "priority"])


SAMPLE_ROWS_SQL = """
with r as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
select o_custkey, count(*) as n_rows, '[' || string_agg(
  '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","priority":'
  || case when o_orderkey % 4 <> 0 then '"' || o_orderpriority || '"' else 'null' end || '}',
  ', ' order by o_orderkey) || ']' as rows_json
from r where rn <= 5 group by o_custkey
"""

QUERIES = {
    "requirements_score": requirements_score,
    "failed_subtasks": failed_subtasks,
    "subtask_tree_text": subtask_tree_text,
    "lessons_parse": lessons_parse,
    "lessons_latest": lessons_latest,
    "lessons_dedup": lessons_dedup,
    "lessons_stream": lessons_stream,
    "lesson_kinds": lesson_kinds,
    "lessons_from_errors": lessons_from_errors,
    "taxonomy_lessons": taxonomy_lessons,
    "step_durations": step_durations,
    "step_totals": step_totals,
    "attempt_outcomes": attempt_outcomes,
    "run_summary": run_summary,
    "hard_failures": hard_failures,
    "lesson_candidates": lesson_candidates,
    "token_usage": token_usage,
    "transcript_text": transcript_text,
    "sample_rows": sample_rows,
}
ORACLES = {
    "requirements_score": REQUIREMENTS_SCORE_SQL,
    "failed_subtasks": FAILED_SUBTASKS_SQL,
    "subtask_tree_text": SUBTASK_TREE_TEXT_SQL,
    "lessons_parse": LESSONS_PARSE_SQL,
    "lessons_latest": LESSONS_LATEST_SQL,
    "lessons_dedup": LESSONS_DEDUP_SQL,
    "lessons_stream": LESSONS_STREAM_SQL,
    "lesson_kinds": LESSON_KINDS_SQL,
    "lessons_from_errors": LESSONS_FROM_ERRORS_SQL,
    "taxonomy_lessons": TAXONOMY_LESSONS_SQL,
    "step_durations": STEP_DURATIONS_SQL,
    "step_totals": STEP_TOTALS_SQL,
    "attempt_outcomes": ATTEMPT_OUTCOMES_SQL,
    "run_summary": RUN_SUMMARY_SQL,
    "hard_failures": HARD_FAILURES_SQL,
    "lesson_candidates": LESSON_CANDIDATES_SQL,
    "token_usage": TOKEN_USAGE_SQL,
    "transcript_text": TRANSCRIPT_TEXT_SQL,
    "sample_rows": SAMPLE_ROWS_SQL,
}
