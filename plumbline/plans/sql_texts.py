"""Registered queries over SQL texts and error messages, and their oracles.

The texts are derived from ``events``, one per event, in all the forms that matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import errors as E
from plumbline.functions import sql_text as S
from plumbline.functions.text import BLANKS
from plumbline.operators import patterns
from plumbline.sources.tables import derive, plain

_BLANKS_SQL = "'" + BLANKS + "'"

ANSWERS = """
select event_id, case event_id % 10
  when 0 then '```sql
SELECT * FROM t' || cast(event_id as string) || ';
```'
  when 1 then '  <thinking>drop it; or
not</thinking>
SELECT a FROM t' || cast(event_id as string) || ' ;; 
'
  when 2 then 'Here it is:
```SQL
SELECT k FROM ' || event_type || '
```
Done.'
  when 3 then 'SELECT 1; SELECT ' || cast(event_id as string) || ';'
  when 4 then 'SELECT ''a;b'' AS x FROM ' || event_type
  when 5 then ' ;  ;' || case when event_id % 20 = 5 then '' else ' SELECT 2' end
  when 6 then '```sql
SELECT open FROM ' || event_type
  when 7 then '```
SELECT first FROM ' || event_type || '
```
then
```sql
SELECT second
```'
  when 8 then '<THINKING>maybe ```sql SELECT x ```</THINKING> SELECT y;'
  else '	' || event_type || '<thinking>a</thinking> or <thinking>b</thinking>' || props
  end as answer
from {events}
"""


def sql_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL in each answer, and the single statement to run."""
    answer = F.col("answer")
    return derive(spark, sf_dir, ANSWERS).select(
        "event_id",
        S.from_answer(answer).alias("answer_sql"),
        S.runnable(answer).alias("run_sql"),
    )


SQL_CLEAN_SQL = plain(
    f"""
with a as (select event_id, trim(answer, {_BLANKS_SQL}) as t from ({ANSWERS})),
u as (select event_id, t,
  case when regexp_matches(t, '(?s)```(?:sql)?\\s*\\n?(.*?)\\n?\\s*```')
       then trim(regexp_extract(t, '(?s)```(?:sql)?\\s*\\n?(.*?)\\n?\\s*```', 1), {_BLANKS_SQL})
       else t end as unfenced
  from a),
r as (select *, rtrim(unfenced, '; ' || chr(10) || chr(9)) as ended from u)
select event_id,
  case when regexp_matches(t, '(?is)```(?:sql)?\\s*\\n?(.*?)\\n?\\s*```')
       then trim(regexp_extract(t, '(?is)```(?:sql)?\\s*\\n?(.*?)\\n?\\s*```', 1), {_BLANKS_SQL})
       else trim(regexp_replace(t, '(?is)<thinking>.*?</thinking>', '', 'g'), {_BLANKS_SQL})
  end as answer_sql,
  case when contains(ended, ';') and trim(split_part(ended, ';', 1), {_BLANKS_SQL}) <> ''
       then trim(split_part(ended, ';', 1), {_BLANKS_SQL}) else ended end as run_sql
from r
"""
)

STATEMENTS = """
select event_id, case event_id % 9
  when 0 then 'SELECT * FROM ' || event_type
  when 1 then '  select a from ' || event_type || ' ; ;'
  when 2 then 'SELECT a FROM t LIMIT
 ' || cast(event_id as string)
  when 3 then 'WITH x AS (SELECT 1) SELECT * FROM x'
  when 4 then 'SHOW TABLES'
  when 5 then 'Describe ' || event_type || ';'
  when 6 then case when event_id % 2 = 0 then '' else '   ' end
  when 7 then 'selection of limits'
  else 'DROP TABLE ' || event_type
  end as sql
from {events}
"""


def recon_guard_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements may run, and the text that runs, with a row cap where it has none."""
    sql = F.col("sql")
    return derive(spark, sf_dir, STATEMENTS).select(
        "event_id",
        S.is_read_only(sql).alias("allowed"),
        F.when(S.is_read_only(sql), S.capped(sql)).alias("run_sql"),
        (S.is_read_only(sql) & S.is_uncapped_select(sql)).alias("was_capped"),
    )


RECON_GUARD_LIMIT_SQL = plain(
    f"""
with s as (select event_id, trim(sql, {_BLANKS_SQL}) as t from ({STATEMENTS})),
w as (select *, lower(regexp_extract(t, '^(\\S+)', 1)) in ('select', 'show', 'describe', 'desc')
        as allowed,
      starts_with(lower(t), 'select') and not regexp_matches(t, '(?i)\\blimit\\s+\\d+') as bare
      from s)
select event_id, allowed, allowed and bare as was_capped,
  case when allowed then
    case when bare then rtrim(t, ';') || chr(10) || 'LIMIT 5' else t end end as run_sql
from w
"""
)

COMPLEX_STATEMENTS = """
select event_id,
  'SELECT ' || case when event_id % 4 = 1 then 'RANK() OVER w ' when event_id % 4 = 2
                    then 'dense_rank() OVER w ' else 'a ' end
  || 'FROM t' || repeat(' JOIN u', cast(event_id % 7 as int))
  || repeat(' join v', cast(event_id % 3 as int))
  || case when event_id % 5 = 0 then ' WHERE a LIKE ''%x''' when event_id % 5 = 1
          then ' WHERE a ilike ''%x''' else '' end
  || repeat(' union all SELECT 1', cast(event_id % 11 as int))
  || repeat(' UNION ALL SELECT 2', cast(event_id % 6 as int)) as sql
from {events}
"""


def timeout_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = F.col("sql")
    return derive(spark, sf_dir, COMPLEX_STATEMENTS).select(
        "event_id", S.has_ranking(sql).alias("has_ranking"), S.estimated_seconds(sql).alias("seconds")
    )


TIMEOUT_ESTIMATE_SQL = plain(
    f"""
with s as ({COMPLEX_STATEMENTS}),
c as (select event_id, sql, upper(sql) as u,
  cast((length(sql) - length(replace(sql, 'JOIN', ''))) / 4 as integer) as joins,
  cast((length(sql) - length(replace(upper(sql), 'UNION ALL', ''))) / 9 as integer) as unions
  from s)
select event_id,
  contains(u, 'RANK()') or contains(u, 'ROW_NUMBER()') or contains(u, 'DENSE_RANK()') as has_ranking,
  cast(least(300, 60 + case when contains(sql, 'LIKE ''%') then 60 else 0 end
    + case when contains(u, 'RANK()') or contains(u, 'ROW_NUMBER()') then 30 else 0 end
    + case when joins > 2 then 20 * (joins - 2) else 0 end + 15 * unions) as integer) as seconds
from c
"""
)

# One message per known text, in changing case and surroundings, some with two texts, and
# one that nothing matches.
_N_KINDS = len(E.ERROR_KINDS)
MESSAGES = (
    f"""
select event_id, user_id, event_id % 31 = 30 as success,
  case when event_id % 37 = 36 then null when event_id % 37 = 35 then ''
  else prefix || case event_id % 3 when 0 then upper(core) when 1 then lower(core) else core end
       || ' near ''' || event_type || '''' end as message
from (select event_id, user_id, event_type,
  case when event_id % 41 = 0 then '003540: unexpected end, ' else '100035: ' end as prefix,
  case event_id % {_N_KINDS + 1} """
    + " ".join(f"when {i} then '{needle}'" for i, (needle, _) in enumerate(E.ERROR_KINDS))
    + """ else 'connection reset' end as core from {events})
"""
)


def classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = E.execution_kind(F.col("success"), F.col("message"))
    return derive(spark, sf_dir, MESSAGES).select("event_id", kind.alias("error_type"))


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of error occurs, and to how many users."""
    kind = E.execution_kind(F.col("success"), F.col("message"))
    return (
        derive(spark, sf_dir, MESSAGES)
        .groupBy(kind.alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n_errors"), F.count_distinct("user_id").alias("n_users"))
    )


_KINDS_SQL = plain(
    f"""
with m as ({MESSAGES}),
k as (select * from (values """
    + ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(E.ERROR_KINDS))
    + """) as t(priority, needle, kind)),
hits as (select event_id, arg_min(kind, priority) as kind
         from m join k on contains(lower(m.message), lower(k.needle)) group by event_id),
found as (select m.event_id, m.user_id,
            case when m.success then 'none' else coalesce(h.kind, 'runtime') end as error_type
          from m left join hits h on h.event_id = m.event_id)
"""
)
CLASSIFY_ERRORS_SQL = _KINDS_SQL + "select event_id, error_type from found"
ERROR_KINDS_SQL = (
    _KINDS_SQL
    + """select error_type, count(*) as n_errors, count(distinct user_id) as n_users
from found group by error_type"""
)

# The known texts as rows, behind one pattern for every third customer.
PATTERNS = (
    """
select cast(c_custkey as bigint) as priority, 'USER ' || c_custkey || ';' as pattern,
  c_mktsegment as kind from {customer} where c_custkey % 3 = 0
union all select * from (values """
    + ", ".join(f"({10**12 + i}, '{n}', '{k}')" for i, (n, k) in enumerate(E.ERROR_KINDS))
    + """) as t(priority, pattern, kind)"""
)
USER_MESSAGES = f"select event_id, message || ' of user ' || user_id || ';' as message from ({MESSAGES})"


def classify_by_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every message by a table of patterns that grows with the customers."""
    messages = derive(spark, sf_dir, USER_MESSAGES)
    kinds = patterns.classify(messages, "message", derive(spark, sf_dir, PATTERNS), E.OTHER_KIND)
    return kinds.select("event_id", "kind")


CLASSIFY_BY_PATTERNS_SQL = plain(
    f"""
with m as ({USER_MESSAGES}), k as ({PATTERNS}),
hits as (select event_id, arg_min(kind, priority) as kind
         from m join k on contains(lower(m.message), lower(k.pattern)) group by event_id)
select m.event_id, coalesce(h.kind, '{E.OTHER_KIND}') as kind
from m left join hits h on h.event_id = m.event_id
"""
)

QUERIES = {
    "sql_clean": sql_clean,
    "recon_guard_limit": recon_guard_limit,
    "timeout_estimate": timeout_estimate,
    "classify_errors": classify_errors,
    "error_kinds": error_kinds,
    "classify_by_patterns": classify_by_patterns,
}
ORACLES = {
    "sql_clean": SQL_CLEAN_SQL,
    "recon_guard_limit": RECON_GUARD_LIMIT_SQL,
    "timeout_estimate": TIMEOUT_ESTIMATE_SQL,
    "classify_errors": CLASSIFY_ERRORS_SQL,
    "error_kinds": ERROR_KINDS_SQL,
    "classify_by_patterns": CLASSIFY_BY_PATTERNS_SQL,
}
