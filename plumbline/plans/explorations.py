"""Registered query of whole transcripts, with the roster of each user's database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalogue as C
from plumbline.operators import prompts as P
from plumbline.operators.transcripts import transcripts
from plumbline.plans.context import CATALOGUE, CATALOGUE_COLUMNS, COLUMN_ROSTER_SQL
from plumbline.plans.records import RECON, portable
from plumbline.sources.tables import derive

# The database of a user is a schema of the derived catalogue; some users have none.
USERS = """
select u.user_id as instance_id, p_type as db_id
from (select distinct user_id from {events} where user_id is not null) u
left join {part} on p_partkey = u.user_id
"""
STEPS = (
    "select *, user_id as instance_id, event_id as step, event_id % 41 = 17 as ready from ("
    + RECON
    + ")"
)
QUERY_BUDGET = 300
BUDGET = 6000


def transcript_with_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript per user: roster of its database, then its steps until it was ready."""
    users = derive(spark, sf_dir, USERS)
    asked = users.select(F.col("db_id").alias("schema_name")).distinct()
    lines = C.column_roster(
        derive(spark, sf_dir, CATALOGUE), derive(spark, sf_dir, CATALOGUE_COLUMNS)
    ).join(asked, "schema_name")  # distinct; a semi join would go below a union with constant names
    rosters = C.roster_text(lines, "schema_name").withColumnRenamed("schema_name", "db_id")
    return transcripts(users, derive(spark, sf_dir, STEPS), rosters, BUDGET, QUERY_BUDGET)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


TRANSCRIPT_SQL = portable(
    f"""
with u as ({USERS}),
roster as (
  select schema_name as db_id, {_text(C.ROSTER_HEAD)}
    || string_agg(line, chr(10) order by table_name) || {_text(C.ROSTER_TAIL)} as roster
  from ({COLUMN_ROSTER_SQL}) group by schema_name),
r as (select * from ({STEPS}) where user_id is not null),
x as (select *, case when not success then 'Error executing query: ' || message
                     when n_rows = 0 then 'Success. (0 rows returned)' else rows_json end as result,
        not regexp_matches(sql, '(?i)\\blimit\\s+\\d+') as bare,
        count(*) filter (ready) over (partition by instance_id order by step
          rows between unbounded preceding and 1 preceding) as earlier from r),
b as (select instance_id, string_agg(case when ready then {_text(P.READY_NOTE)} else
    case when bare then {_text(P.CAP_NOTE)} else '' end
    || '**Agent Recon Query:**' || chr(10) || '```sql' || chr(10) || sql
    || case when bare then chr(10) || 'LIMIT 5' else '' end || chr(10) || '```' || chr(10) || chr(10)
    || '**Database Result:**' || chr(10)
    || case when length(result) > {QUERY_BUDGET} then left(result, {QUERY_BUDGET}) || chr(10)
       || '... [SYSTEM WARNING: Result truncated. Rewrite your query to be more targeted.]'
       else result end || chr(10) || chr(10) end, '' order by step) as steps
  from x where earlier = 0 group by instance_id),
w as (select u.instance_id, {_text(P.TRANSCRIPT_HEAD)} || coalesce(roster, '') || coalesce(steps, '') as t
  from u left join roster on roster.db_id = u.db_id left join b on b.instance_id = u.instance_id)
select instance_id, case when length(t) > {BUDGET} then left(t, {BUDGET})
  || chr(10) || '... (exploration transcript truncated)' || chr(10) else t end as transcript
from w
"""
)

QUERIES = {"transcript_with_roster": transcript_with_roster}
ORACLES = {"transcript_with_roster": TRANSCRIPT_SQL}
