"""Registered grading queries: inputs derived from the given tables, and their oracles.

``orders`` and ``events`` have dense keys, so blocks of 50 keys are result tables with rows
0..49; ``lineitem`` rows grouped by part are result tables without a row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import grading as G
from plumbline.sources.tables import derive, plain

# ------------------------------------------------------------------ ordered comparison

# Five gold columns; the prediction has them in another order plus an extra one. By instance
# it keeps the values, moves them within or beyond the tolerance, swaps rows, blanks a value
# or changes a text.
ORDERED_GOLD = """
select cast(floor(o_orderkey / 50) as bigint) as inst,
       o_orderkey % 50 as pos,
       o_totalprice as g0,
       o_orderpriority as g1,
       case when o_orderkey % 11 = 0 then null else o_custkey end as g2,
       o_orderstatus as g3,
       case when o_orderkey % 50 < 48 then o_totalprice * 1000000 else null end as g4
from {orders}
"""
ORDERED_PRED = """
select inst,
       case when inst % 6 = 4 then 49 - pos else pos end as pos,
       case when inst % 6 = 5 and pos = 7 then lower(g1) else g1 end as p0,
       g2 + case when inst % 6 = 3 and pos = 20 then 1 else 0 end as p1,
       pos * 1.5 as p2,
       g0 + case inst % 6 when 1 then 0.004 when 2 then 0.02 else 0.0 end as p3,
       case when inst % 7 = 6 and pos = 49 then null else g3 end as p4,
       g4 * (1.0 + case when inst % 5 = 1 then 0.0000000005 else 0.0 end) as p5
from (""" + ORDERED_GOLD + ")"
ORDERED_STANDARD = """
select distinct cast(floor(o_orderkey / 50) as string) as instance_id,
       false as ignore_order,
       '[]' as condition_cols_raw
from {orders}
"""
GOLD_COLUMNS = ["g0", "g1", "g2", "g3", "g4"]
PRED_COLUMNS = ["p0", "p1", "p2", "p3", "p4", "p5"]


def _side(spark, sf_dir, text, columns, variant=None):
    rows = derive(spark, sf_dir, text)
    return (
        G.tables_of(rows, "inst", columns, variant),
        G.rows_of(rows, "inst", "pos", columns, variant),
    )


def compare_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _side(spark, sf_dir, ORDERED_GOLD, GOLD_COLUMNS)
    pred = _side(spark, sf_dir, ORDERED_PRED, PRED_COLUMNS)
    standards = derive(spark, sf_dir, ORDERED_STANDARD.replace("as string", "as bigint"))
    standards = standards.withColumn("instance_id", F.col("instance_id").cast("string"))
    return G.match_golds(standards, *pred, *gold).select("instance_id", "matched")


def _cells_sql(name: str, source: str, columns: dict[str, str], extra: str = "") -> str:
    """Oracle cells: one row per value, NULLs included. ``columns`` maps name -> n or t."""
    parts = [
        f"select inst{extra}, pos, {i} as col, "
        + (f"cast({c} as double) as num, cast(null as varchar) as txt, 'n' as kind"
           if k == "n" else f"cast(null as double) as num, {c} as txt, 't' as kind")
        + f" from {source}"
        for i, (c, k) in enumerate(columns.items())
    ]
    return f"{name} as (" + " union all ".join(parts) + ")"


_GOLD_KINDS = dict(zip(GOLD_COLUMNS, "ntntn"))
_PRED_KINDS = dict(zip(PRED_COLUMNS, "tnnntn"))
_CLOSE = """(g.num is null and p.num is null and g.txt is null and p.txt is null)
    or coalesce(g.txt = p.txt, false)
    or coalesce(g.num = p.num, false)
    or coalesce(isfinite(g.num) and isfinite(p.num)
        and abs(g.num - p.num) <= greatest(0.01, 1e-9 * greatest(abs(g.num), abs(p.num))), false)"""

COMPARE_ORDERED_SQL = plain(
    f"""
with gold as ({ORDERED_GOLD}), pred as ({ORDERED_PRED}),
{_cells_sql("gc", "gold", _GOLD_KINDS)},
{_cells_sql("pc", "pred", _PRED_KINDS)},
pairs as (
  select g.inst, g.col as gcol, p.col as pcol, bool_and({_CLOSE}) as fits
  from gc g join pc p on g.inst = p.inst and g.pos = p.pos
  group by 1, 2, 3),
cols as (select inst, gcol, bool_or(fits) as fits from pairs group by 1, 2)
select cast(inst as varchar) as instance_id, bool_and(fits) as matched
from cols group by inst
"""
)

# ---------------------------------------------------------------- unordered comparison

UNORDERED_GOLD = """
select l_partkey as inst, l_orderkey as pos, l_extendedprice as g0, l_quantity as g1,
       l_returnflag as g2,
       case when l_linenumber = 3 then null else l_discount end as g3
from {lineitem}
"""
UNORDERED_PRED = """
select inst, 0 - pos as pos,
       g2 as p0,
       case when inst % 4 = 1 and g1 > 45 then g1 + 0.5 else g1 + 0.004 end as p1,
       case when inst % 7 = 2 and g3 > 0.09 then null else g3 end as p2,
       g0 + case inst % 5 when 1 then 0.006 when 2 then 0.02 else 0.0 end as p3
from (""" + UNORDERED_GOLD + ")"
UNORDERED_GOLD_COLUMNS = ["g0", "g1", "g2", "g3"]
UNORDERED_PRED_COLUMNS = ["p0", "p1", "p2", "p3"]


def compare_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _side(spark, sf_dir, UNORDERED_GOLD, UNORDERED_GOLD_COLUMNS)
    pred = _side(spark, sf_dir, UNORDERED_PRED, UNORDERED_PRED_COLUMNS)
    standards = gold[0].select(
        "instance_id",
        F.lit(True).alias("ignore_order"),
        F.lit("[[]]").alias("condition_cols_raw"),
    )
    return G.match_golds(standards, *pred, *gold).select("instance_id", "matched")


_U_GOLD_KINDS = dict(zip(UNORDERED_GOLD_COLUMNS, "nntn"))
_U_PRED_KINDS = dict(zip(UNORDERED_PRED_COLUMNS, "tnnn"))

COMPARE_UNORDERED_SQL = plain(
    f"""
with gold as ({UNORDERED_GOLD}), pred as ({UNORDERED_PRED}),
{_cells_sql("gc0", "gold", _U_GOLD_KINDS)},
{_cells_sql("pc0", "pred", _U_PRED_KINDS)},
gc as (select inst, col, num, txt, row_number() over
         (partition by inst, col order by num nulls last, txt nulls last) as r from gc0),
pc as (select inst, col, num, txt, row_number() over
         (partition by inst, col order by num nulls last, txt nulls last) as r from pc0),
pairs as (
  select g.inst, g.col as gcol, p.col as pcol, bool_and({_CLOSE}) as fits
  from gc g join pc p on g.inst = p.inst and g.r = p.r
  group by 1, 2, 3),
cols as (select inst, gcol, bool_or(fits) as fits from pairs group by 1, 2)
select cast(inst as varchar) as instance_id, bool_and(fits) as matched
from cols group by inst
"""
)

# ------------------------------------------------------- several golds, all five states

# Up to three gold tables per instance: the exact one, one moved beyond the tolerance, and
# one with fewer rows. The choice of columns takes every accepted shape.
MULTI_GOLD = """
select inst, pos, variant, v0 as g0, v1 as g1, v2 as g2 from (
  select cast(floor(event_id / 50) as bigint) as inst, event_id % 50 as pos, 0 as variant,
         value + case when floor(event_id / 50) % 3 = 0 then 0.0 else 5.0 end as v0,
         event_type as v1, user_id as v2
  from {events}
  union all
  select cast(floor(event_id / 50) as bigint), event_id % 50, 1, value, event_type, user_id + 1
  from {events} where floor(event_id / 50) % 2 = 1
  union all
  select cast(floor(event_id / 50) as bigint), event_id % 50, 2, value, event_type, user_id
  from {events} where floor(event_id / 50) % 4 = 3 and event_id % 50 < 40
)
where inst % 17 <> 5
"""
MULTI_PRED = """
select cast(floor(event_id / 50) as bigint) as inst,
       case when floor(event_id / 50) % 2 = 0 then event_id % 50 else 49 - event_id % 50 end as pos,
       user_id as p0,
       value + case when floor(event_id / 50) % 9 = 4 then 0.003 else 0.0 end as p1,
       event_type as p2
from {events}
where floor(event_id / 50) % 13 <> 7 and floor(event_id / 50) % 19 <> 3
"""
MULTI_STANDARD = """
select inst, cast(inst as string) as instance_id,
       inst % 2 = 1 as ignore_order,
       case inst % 8
            when 0 then '[]' when 1 then '[0]' when 2 then '[[]]' when 3 then '[[0, 1], [1, 2]]'
            when 4 then '[null]' when 5 then '[0, 1]' when 6 then '[1, 2]' else null
       end as condition_cols_raw
from (select distinct cast(floor(event_id / 50) as bigint) as inst from {events})
"""
# Predictions that exist but cannot be read.
MULTI_BROKEN = """
select cast(inst as string) as instance_id, 0 as variant, cast(0 as bigint) as n_rows,
       0 as n_cols, false as readable, 'no columns to parse' as read_error
from (select distinct cast(floor(event_id / 50) as bigint) as inst from {events})
where inst % 19 = 3
"""
MULTI_SQL = """
select cast(inst as string) as instance_id,
       'select * from t' || cast(inst as string) as sql
from (select distinct cast(floor(event_id / 50) as bigint) as inst from {events})
where inst % 6 <> 1
"""
MULTI_QUESTION = """
select cast(inst as string) as instance_id,
       'question ' || cast(inst as string) as nlq
from (select distinct cast(floor(event_id / 50) as bigint) as inst from {events})
where inst % 10 <> 9
"""
GOLD_TABLE_COLUMNS = ["g0", "g1", "g2"]
PREDICTED_COLUMNS = ["p0", "p1", "p2"]


def _multi_inputs(spark: SparkSession, sf_dir: str):
    gold_tables, gold_cells = _side(spark, sf_dir, MULTI_GOLD, GOLD_TABLE_COLUMNS, "variant")
    pred_tables, pred_cells = _side(spark, sf_dir, MULTI_PRED, PREDICTED_COLUMNS)
    broken = derive(spark, sf_dir, MULTI_BROKEN)
    pred_tables = pred_tables.withColumn("read_error", F.lit(None).cast("string"))
    # Gold tables are numbered densely in their order, as when they are read from files.
    return (
        derive(spark, sf_dir, MULTI_STANDARD).drop("inst"),
        pred_tables.unionByName(broken),
        pred_cells,
        gold_tables,
        gold_cells,
    )


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.grade(*_multi_inputs(spark, sf_dir))


def grade_multi_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.match_golds(*_multi_inputs(spark, sf_dir))


def grade_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.per_instance(_grades(spark, sf_dir))


def grade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.report(_grades(spark, sf_dir)).select(
        "total",
        "correct",
        "wrong_result",
        "execution_error",
        "missing",
        F.round("accuracy", 6).alias("accuracy"),
        F.round("accuracy_evaluated", 6).alias("accuracy_evaluated"),
    )


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.failures(
        _grades(spark, sf_dir),
        derive(spark, sf_dir, MULTI_SQL),
        derive(spark, sf_dir, MULTI_QUESTION),
    )


def grade_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir)


def failure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    standards = derive(spark, sf_dir, MULTI_STANDARD).withColumnRenamed("inst", "pos")
    return G.failure_digest(_failures(spark, sf_dir), standards=standards)


_MULTI_CTES = f"""
gold as ({MULTI_GOLD}), pred as ({MULTI_PRED}), std as ({MULTI_STANDARD}),
broken as ({MULTI_BROKEN}),
{_cells_sql("gc0", "gold", dict(zip(GOLD_TABLE_COLUMNS, "ntn")), ", variant")},
{_cells_sql("pc0", "pred", dict(zip(PREDICTED_COLUMNS, "nnt")))},
gt as (select inst, variant, count(*) as n from gold group by 1, 2),
pt as (select inst, count(*) as n from pred group by 1),
need as (
  select gt.inst, gt.variant, gt.n, std.ignore_order,
    case inst % 8
      when 1 then [0]
      when 3 then case variant when 0 then [0, 1] when 1 then [1, 2] else [0, 1, 2] end
      when 5 then [0, 1] when 6 then [1, 2] else [0, 1, 2] end as wanted
  from gt join std using (inst)),
gc as (select gc0.*, row_number() over (partition by gc0.inst, gc0.variant, col order by
         case when ignore_order then num end nulls last,
         case when ignore_order then txt end nulls last, pos) as r
       from gc0 join need on gc0.inst = need.inst and gc0.variant = need.variant
       where list_contains(wanted, col)),
pc as (select pc0.*, row_number() over (partition by pc0.inst, col order by
         case when ignore_order then num end nulls last,
         case when ignore_order then txt end nulls last, pos) as r
       from pc0 join std using (inst)),
pairs as (
  select g.inst, g.variant, g.col as gcol, p.col as pcol, bool_and({_CLOSE}) as fits
  from gc g join pc p on g.inst = p.inst and g.r = p.r
  group by 1, 2, 3, 4),
cols as (select inst, variant, gcol, bool_or(fits) as fits from pairs group by 1, 2, 3),
golds as (
  select need.inst, need.variant,
         coalesce(bool_and(cols.fits), false) and need.n = max(pt.n) as matched
  from need join pt on need.inst = pt.inst
       left join cols on cols.inst = need.inst and cols.variant = need.variant
  group by need.inst, need.variant, need.n),
statuses as (
  select std.instance_id, std.inst,
    case when broken.instance_id is not null then 'execution_error'
         when pt.inst is null then 'missing'
         when first_gold.inst is null then 'missing_gold'
         when best.matched then 'correct' else 'wrong_result' end as status,
    pt.n as pn, first_gold.n as gn
  from std
  left join broken on broken.instance_id = std.instance_id
  left join pt on pt.inst = std.inst
  left join (select inst, arg_min(n, variant) as n from gt group by 1) first_gold
    on first_gold.inst = std.inst
  left join (select inst, bool_or(matched) as matched from golds group by 1) best
    on best.inst = std.inst),
fails as (
  select s.instance_id,
    case when status = 'wrong_result' then status else 'execution_error' end as error_type,
    coalesce(q.sql, '') as sql,
    case status when 'missing' then 'No prediction CSV found'
                when 'execution_error' then 'Could not read prediction CSV: no columns to parse'
                else '' end as error_message,
    case when status = 'wrong_result' then 'Result mismatch: pred shape=(' || pn
         || ', 3), gold shape=(' || gn || ', 3)' else '' end as details,
    coalesce(n.nlq, '') as nlq
  from statuses s
  left join ({MULTI_SQL}) q on q.instance_id = s.instance_id
  left join ({MULTI_QUESTION}) n on n.instance_id = s.instance_id
  where status in ('wrong_result', 'execution_error', 'missing'))
"""

GRADE_MULTI_GOLD_SQL = plain(
    f"with {_MULTI_CTES} select cast(inst as varchar) as instance_id, variant, matched from golds"
)
GRADE_STATUS_SQL = plain(f"with {_MULTI_CTES} select instance_id, status from statuses")
GRADE_REPORT_SQL = plain(
    f"""with {_MULTI_CTES}
select count(*) as total, count(*) filter (status = 'correct') as correct,
  count(*) filter (status = 'wrong_result') as wrong_result,
  count(*) filter (status = 'execution_error') as execution_error,
  count(*) filter (status in ('missing', 'missing_gold')) as missing,
  round(count(*) filter (status = 'correct') / count(*), 6) as accuracy,
  round(count(*) filter (status = 'correct')
        / count(*) filter (status in ('correct', 'wrong_result')), 6) as accuracy_evaluated
from statuses"""
)
GRADE_FAILURES_SQL = plain(f"with {_MULTI_CTES} select * from fails")
FAILURE_DIGEST_SQL = plain(
    f"""with {_MULTI_CTES},
top as (select * from fails order by cast(instance_id as bigint) limit 20)
select count(*) as n_failures,
  string_agg('Instance: ' || instance_id || chr(10) || 'Question: ' || nlq || chr(10)
    || 'Error Type: ' || error_type || chr(10) || 'SQL:' || chr(10) || sql || chr(10)
    || 'Error/Details: ' || case when error_message <> '' then error_message else details end,
    chr(10) || '---' || chr(10) order by cast(instance_id as bigint)) as digest
from top"""
)

# ---------------------------------------------------------------------- result profile

# Every customer asks one query; the result for an even key is the orders of that customer and
# the next, that for an odd key is empty, and the values of some results are all NULL.
PROFILE_INSTANCES = "select cast(c_custkey as string) as instance_id from {customer}"
PROFILE_ROWS = """
select inst, o_orderkey as pos,
       case when inst % 9 = 4 then null else o_totalprice end as a,
       case when inst % 3 = 1 then null else o_orderstatus end as b
from (select *, o_custkey - o_custkey % 2 as inst from {orders})
"""


def result_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, cells = _side(spark, sf_dir, PROFILE_ROWS, ["a", "b"])
    return G.profile(derive(spark, sf_dir, PROFILE_INSTANCES), tables, cells)


RESULT_PROFILE_SQL = plain(
    f"""
with i as ({PROFILE_INSTANCES}),
r as (select cast(inst as varchar) as instance_id, count(*) as n_rows,
             count(a) + count(b) as n_values from ({PROFILE_ROWS}) group by 1)
select i.instance_id, coalesce(n_rows, 0) as n_rows, coalesce(n_values, 0) as n_values,
  case when coalesce(n_rows, 0) = 0 then 'empty_result'
       when coalesce(n_values, 0) = 0 then 'null_result' else 'none' end as error_type
from i left join r using (instance_id)
"""
)

QUERIES = {
    "compare_ordered": compare_ordered,
    "compare_unordered": compare_unordered,
    "grade_multi_gold": grade_multi_gold,
    "grade_status": grade_status,
    "grade_report": grade_report,
    "grade_failures": grade_failures,
    "failure_digest": failure_digest,
    "result_profile": result_profile,
}
ORACLES = {
    "compare_ordered": COMPARE_ORDERED_SQL,
    "compare_unordered": COMPARE_UNORDERED_SQL,
    "grade_multi_gold": GRADE_MULTI_GOLD_SQL,
    "grade_status": GRADE_STATUS_SQL,
    "grade_report": GRADE_REPORT_SQL,
    "grade_failures": GRADE_FAILURES_SQL,
    "failure_digest": FAILURE_DIGEST_SQL,
    "result_profile": RESULT_PROFILE_SQL,
}
