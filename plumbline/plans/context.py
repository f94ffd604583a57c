"""Registered catalogue, document and prompt queries, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.answers import tree_text
from plumbline.operators import catalogue as C
from plumbline.operators import lessons as L
from plumbline.operators import prompts as P
from plumbline.operators.batch import run_batch
from plumbline.plans import records
from plumbline.session import fresh_path, shared_folder
from plumbline.sources.questions import normalise
from plumbline.sources.tables import derive, load, plain, spread

# ------------------------------------------------------------------------- catalogue

# A catalogue that grows with the data: a shard per customer in the schema of its segment,
# pairs of shards per supplier (too few for a group), and a plain table per part.
CATALOGUE = """
select c_mktsegment as schema_name,
       'CUST_' || cast(c_nationkey as string) || '_' || lpad(cast(c_custkey as string), 8, '0')
         as table_name,
       c_custkey as pos
from {customer}
union all
select 'SUPPLY', 'PAIR_' || cast(cast(floor(s_suppkey / 2) as bigint) as string) || '_'
         || lpad(cast(s_suppkey % 2 + 1 as string), 4, '0'), 1000000000 - s_suppkey
from {supplier}
union all
select case when p_partkey % 3 = 0 then 'SUPPLY' else p_type end,
       'part' || cast(p_partkey as string) || case when p_size % 2 = 0 then '_X' else '_12' end,
       p_partkey
from {part}
"""
CATALOGUE_COLUMNS = """
select schema_name, table_name, cast(1 as int) as ordinal, 'ID' as column_name,
       'NUMBER' as data_type
from (""" + CATALOGUE + """)
union all
select schema_name, table_name, 2, case when pos % 2 = 0 then 'Name' else 'name' end, 'TEXT'
from (""" + CATALOGUE + """)
union all
select schema_name, table_name, 3, 'VALUE_' || cast(pos % 7 as string), 'FLOAT'
from (""" + CATALOGUE + """) where pos % 5 <> 0
"""

_GROUPED_SQL = plain(
    f"""
t as (select *, regexp_matches(table_name, '^(.+?)_(\\d{{4,8}})$') as is_shard,
        case when regexp_matches(table_name, '^(.+?)_(\\d{{4,8}})$')
             then regexp_extract(table_name, '^(.+?)_(\\d{{4,8}})$', 1) end as prefix,
        regexp_extract(table_name, '^(.+?)_(\\d{{4,8}})$', 2) as shard
      from ({CATALOGUE})),
g as (select schema_name, prefix, count(*) as n_tables, min(shard) as min_key,
        max(shard) as max_key, min(table_name) as representative, min(pos) as first_pos
      from t where is_shard group by 1, 2)
"""
)


def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shard_groups(derive(spark, sf_dir, CATALOGUE))


SHARD_GROUPS_SQL = (
    f"with {_GROUPED_SQL} select schema_name, prefix, n_tables, min_key, max_key, representative "
    "from g where n_tables >= 3"
)


def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per schema, the line that names its regular tables."""
    listed = C.grouped_tables(derive(spark, sf_dir, CATALOGUE))
    return C.name_lists(listed, ["schema_name"])


TABLE_NAMES_SQL = f"""
with {_GROUPED_SQL},
r as (select t.schema_name, t.table_name,
        row_number() over (partition by t.schema_name order by t.is_shard,
          case when t.is_shard then g.first_pos end, t.pos) as rn,
        count(*) over (partition by t.schema_name) as n
      from t left join g on g.schema_name = t.schema_name and g.prefix = t.prefix
      where not t.is_shard or g.n_tables < 3)
select schema_name,
  case when max(n) > 15 then 'TABLES (' || max(n) || ' total): '
         || string_agg(table_name, ', ' order by rn) || '... (and ' || (max(n) - 15) || ' more)'
       else 'TABLES: ' || string_agg(table_name, ', ' order by rn) end || chr(10) || chr(10) as text
from r where rn <= 15 group by schema_name
"""


def column_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.column_roster(
        derive(spark, sf_dir, CATALOGUE), derive(spark, sf_dir, CATALOGUE_COLUMNS)
    )


COLUMN_ROSTER_SQL = plain(
    f"""
with {_GROUPED_SQL},
c as ({CATALOGUE_COLUMNS}),
listed as (
  select schema_name, representative as table_name,
    schema_name || '.' || prefix || '_* (' || n_tables || ' partitions, representative: '
      || representative || ')' as label
  from g where n_tables >= 3
  union all
  select t.schema_name, t.table_name, t.schema_name || '.' || t.table_name
  from t left join g on g.schema_name = t.schema_name and g.prefix = t.prefix
  where not t.is_shard or g.n_tables < 3)
select c.schema_name, c.table_name, count(*) as n_columns,
  label || ': ' || string_agg(
    case when column_name <> upper(column_name) then '"' || column_name || '"' else column_name end
    || ' (' || data_type || ')', ', ' order by ordinal) as line
from c join listed on c.schema_name = listed.schema_name and c.table_name = listed.table_name
group by c.schema_name, c.table_name, label
"""
)

# A database per brand with a schema per kind of part; every fourth part is a shard.
DDL_TABLES = """
select 'DB' || substr(p_brand, 7) as db_id, p_type as schema_name,
       case when p_partkey % 4 = 0
            then 'LOG' || cast(p_size % 3 as string) || '_' || lpad(cast(p_partkey as string), 8, '0')
            else 'T' || cast(p_partkey as string) end as table_name,
       p_partkey as pos,
       'CREATE TABLE x (
  id NUMBER,
  "' || p_name || '" TEXT' || repeat(',
  c NUMBER', cast(p_partkey % 5 as int)) || '
);' as ddl
from {part}
"""
DDL_BUDGET = 4000
SHORT_BUDGET = 500


def _ddl(spark: SparkSession, sf_dir: str, *budgets: int) -> DataFrame:
    return C.schema_texts(derive(spark, sf_dir, DDL_TABLES), *budgets)


def ddl_budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema text per database under a wide and a narrow budget."""
    return _ddl(spark, sf_dir, DDL_BUDGET, SHORT_BUDGET)


_DDL_PIECES_SQL = plain(
    f"""
t as (select *, regexp_matches(table_name, '^(.+?)_(\\d{{4,8}})$') as is_shard,
        regexp_extract(table_name, '^(.+?)_(\\d{{4,8}})$', 1) as prefix,
        regexp_extract(table_name, '^(.+?)_(\\d{{4,8}})$', 2) as shard
      from ({DDL_TABLES})),
g as (select db_id, schema_name, prefix, count(*) as n, min(shard) as min_key,
        max(shard) as max_key, arg_min(ddl, table_name) as ddl, min(pos) as first_pos
      from t where is_shard group by 1, 2, 3),
r as (select t.*, g.first_pos from t left join g
        on is_shard and g.db_id = t.db_id and g.schema_name = t.schema_name and g.prefix = t.prefix
      where not is_shard or g.n < 3),
ranked as (select *, row_number() over (partition by db_id, schema_name
             order by is_shard, first_pos, pos) as rn from r),
counts as (select db_id, schema_name, count(*) as n from r group by 1, 2),
names as (
  select ranked.db_id, ranked.schema_name,
    case when max(n) > 15 then 'TABLES (' || max(n) || ' total): '
           || string_agg(table_name, ', ' order by rn) || '... (and ' || (max(n) - 15) || ' more)'
         else 'TABLES: ' || string_agg(table_name, ', ' order by rn) end as line
  from ranked join counts on counts.db_id = ranked.db_id and counts.schema_name = ranked.schema_name
  where rn <= 15 group by 1, 2),
pieces as (
  select db_id, schema_name, 0 as section, 0 as place,
    'DATABASE: ' || db_id || ' | SCHEMA: ' || schema_name || chr(10) || 'Full path format: '
    || db_id || '.' || schema_name || '.TABLE_NAME' || chr(10)
    || 'IMPORTANT: Quote column names exactly as shown in DDL.' || chr(10) || chr(10) as text
  from (select distinct db_id, schema_name from t)
  union all
  select db_id, schema_name, 1, first_pos,
    'PARTITIONED TABLES — prefix ''' || prefix || ''' (' || n || ' tables):' || chr(10)
    || '- Pattern: ' || prefix || '_<KEY> (key range: ' || min_key || ' to ' || max_key || ')'
    || chr(10) || '- Use UNION ALL to query across multiple partitions (no wildcards).'
    || chr(10) || chr(10) || 'SAMPLE STRUCTURE (all ''' || prefix
    || ''' tables share this schema):' || chr(10) || 'Table: ' || db_id || '.' || schema_name || '.'
    || prefix || '_<KEY>' || chr(10) || ddl || chr(10) || chr(10)
  from g where n >= 3
  union all
  select db_id, schema_name, 2, 0,
    line || chr(10) || chr(10) || 'TABLE STRUCTURES:' || chr(10) || chr(10) from names
  union all
  select db_id, schema_name, 3, pos,
    '-- ' || db_id || '.' || schema_name || '.' || table_name || chr(10) || ddl || chr(10) || chr(10)
  from r),
blocks as (select db_id, schema_name, string_agg(text, '' order by section, place) as block
           from pieces group by 1, 2),
whole as (select db_id, string_agg(block, chr(10) order by schema_name) as text
          from blocks group by 1)
"""
)


def _cut_sql(budget: int) -> str:
    mark = "'--' || chr(10) || chr(10)"
    found = f"strpos(reverse(left(text, {budget})), {mark})"
    return f"""
select db_id, length(text) > {budget} as truncated, {budget} as budget,
  case when length(text) <= {budget} then text
       when {found} > 0 then left(text, {budget} - {found} - 3)
       else left(text, {budget}) end
  || case when length(text) > {budget} then chr(10) || '... (truncated)' || chr(10) else '' end
    as ddl
from whole"""


DDL_BUDGET_CUT_SQL = (
    f"with {_DDL_PIECES_SQL} {_cut_sql(DDL_BUDGET)} union all {_cut_sql(SHORT_BUDGET)}"
)

# ------------------------------------------------------------------------- documents

# Some documents get heads, indented or inside the text; the others stay without.
DOCS = """
select doc_id, lang, source,
       case doc_id % 4
         when 0 then '# Title ' || source || '
' || replace(text, '. ', '.
##  part   of
 # no head
')
         when 1 then replace(text, '
', '
### ')
         else text end as content
from {documents}
"""
DOCS_BUDGET = 3000


def doc_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its table of contents in front."""
    content = F.col("content")
    return spread(derive(spark, sf_dir, DOCS)).select(
        "doc_id",
        T.contents(content).alias("contents"),
        T.with_contents(content).alias("text"),
    )


_LINE_END_SQL = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\u2028\u2029]'"
_BLANKS_SQL = "'" + T.BLANKS + "'"
_TOC_CTES = plain(
    f"""
d as ({DOCS}),
h as (select doc_id, content, list_transform(
        list_filter(regexp_split_to_array(content, {_LINE_END_SQL}), lambda x: starts_with(x, '#')),
        lambda x: trim(x, {_BLANKS_SQL})) as heads from d),
w as (select doc_id, array_to_string(heads, chr(10)) as contents,
        case when len(heads) > 0 then '## DOCUMENTATION TABLE OF CONTENTS' || chr(10)
               || array_to_string(heads, chr(10)) || chr(10) || chr(10) || content
             else content end as text from h)
"""
)
DOC_TOC_SQL = f"with {_TOC_CTES} select doc_id, contents, text from w"


def doc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with contents, cut to the budget; the marker comes on top of it."""
    text = T.with_contents(F.col("content"))
    return spread(derive(spark, sf_dir, DOCS)).select(
        "doc_id",
        F.length(text).cast("bigint").alias("full_length"),
        T.truncate(text, DOCS_BUDGET).alias("text"),
    )


DOC_TRUNCATE_SQL = f"""
with {_TOC_CTES}
select doc_id, length(text) as full_length,
  case when length(text) > {DOCS_BUDGET}
       then left(text, {DOCS_BUDGET}) || chr(10) || '... (truncated)' || chr(10) else text end as text
from w
"""

# --------------------------------------------------------------------------- prompts

# Every user turn is a question about one of the databases; a third of the questions name a
# document, some of which do not exist. The turn decides the shape of the prompt.
QUESTIONS = """
select conv_id, turn, cast(conv_id as string) || '/' || cast(turn as string) as instance_id,
       case when turn % 3 = 0 then text end as instruction, text as question,
       'DB' || cast(conv_id % 27 + 1 as string) as db_id,
       case when conv_id % 3 = 0 then 'doc' || cast(conv_id as string) end as external_knowledge,
       case turn % 3 when 0 then 'first' when 1 then 'requirements' else 'execution' end as shape,
       turn + 1 as attempt, 'SELECT ' || cast(conv_id as string) as previous_sql,
       '- Subtask #2: wrong' as failed_subtasks, 'syntax' as error_type,
       'invalid identifier' as error_message, turn as pos
from {conversations} where role <> 'assistant'
"""
DOC_NAMES = "select 'doc' || cast(doc_id as string) as name, content from (" + DOCS + ")"
PROMPT_LESSONS = 5


def questions_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(derive(spark, sf_dir, QUESTIONS)).select(
        "instance_id", "nlq", "db_id", "external_knowledge"
    )


QUESTIONS_SQL = plain(
    f"""select instance_id, coalesce(instruction, question, '') as nlq, db_id,
  coalesce(external_knowledge, '') as external_knowledge from ({QUESTIONS})"""
)


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = derive(spark, sf_dir, QUESTIONS)
    questions = normalise(asked).join(
        asked.drop("db_id", "external_knowledge", "question", "instruction", "pos"), "instance_id"
    )
    return P.load_context(
        questions, _ddl(spark, sf_dir, DDL_BUDGET), derive(spark, sf_dir, DOC_NAMES), DOCS_BUDGET
    )


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt of every question: schema, document, transcript, lessons, subtasks, feedback."""
    trees = records._trees(spark, sf_dir).select(
        "conv_id", "turn", tree_text(F.col("tree")).alias("tree_text")
    )
    transcripts = records.transcript_text(spark, sf_dir).withColumnRenamed("user_id", "conv_id")
    context = (
        _context(spark, sf_dir)
        .join(trees, ["conv_id", "turn"])
        .join(transcripts, "conv_id", "left")
        .withColumn("transcript", F.coalesce("transcript", F.lit("")))
    )
    lessons = L.lessons_text(derive(spark, sf_dir, records.LESSONS), PROMPT_LESSONS)
    prompts = P.assemble(context, lessons)
    return prompts.select(
        "instance_id",
        "shape",
        F.length("prompt").cast("bigint").alias("n_chars"),
        F.md5("prompt").alias("prompt_md5"),
    )


PROMPT_TABLE_SQL = f"""
with q as ({plain(QUESTIONS)}),
ddl as (with {_DDL_PIECES_SQL} {_cut_sql(DDL_BUDGET)}),
docs as (with {_TOC_CTES}
  select 'doc' || doc_id as name,
    case when length(text) > {DOCS_BUDGET}
         then left(text, {DOCS_BUDGET}) || chr(10) || '... (truncated)' || chr(10) else text end as docs
  from w),
trees as ({records.SUBTASK_TREE_TEXT_SQL}),
scripts as ({records.TRANSCRIPT_TEXT_SQL}),
lessons as ({records._LESSONS_TEXT_SQL.replace("limit 40", f"limit {PROMPT_LESSONS}")}),
p as (
  select q.instance_id, q.shape,
    case q.shape when 'first' then 'Write a Spark SQL query to answer the question.'
      when 'requirements' then 'Fix your SQL — it failed requirements.'
      else 'Fix your SQL — it hit a Spark error.' end
    || repeat(chr(10), 2) || 'SCHEMA:' || chr(10) || coalesce(ddl.ddl, '')
    || repeat(chr(10), 2)
    || case when coalesce(docs.docs, '') <> '' then 'ADDITIONAL DOCUMENTATION:' || chr(10) || docs.docs
       else '' end
    || repeat(chr(10), 2) || coalesce(scripts.transcript, '')
    || repeat(chr(10), 2) || 'LEARNINGS:' || chr(10) || (select lessons from lessons)
    || repeat(chr(10), 2) || 'SUBTASKS:' || chr(10) || trees.tree_text
    || repeat(chr(10), 2) || 'QUESTION: ' || coalesce(q.instruction, q.question)
    || case when q.shape = 'first' then '' else
       repeat(chr(10), 2) || 'PREVIOUS SQL (attempt ' || q.attempt || '):' || chr(10) || '```'
       || chr(10) || q.previous_sql || chr(10) || '```' || repeat(chr(10), 2)
       || case q.shape when 'requirements' then 'FAILED SUBTASKS:' || chr(10) || q.failed_subtasks
          else 'ERROR (' || q.error_type || '): ' || q.error_message end end
    || repeat(chr(10), 2) || 'Output <thinking> then ```sql:' as prompt
  from q
  left join ddl on ddl.db_id = q.db_id
  left join docs on docs.name = q.external_knowledge
  left join trees on trees.conv_id = q.conv_id and trees.turn = q.turn
  left join scripts on scripts.user_id = q.conv_id)
select instance_id, shape, length(prompt) as n_chars, md5(prompt) as prompt_md5 from p
"""

# ------------------------------------------------------------------------ query batch

# Two statements per region over the whole tables, one of them failing for some regions.
BATCH = """
select 'a' || cast(r_regionkey as string) as instance_id,
       '```sql
SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey '
       || 'WHERE n_regionkey = ' || cast(r_regionkey as string) || ';
```' as sql
from {region}
union all
select 'b' || cast(r_regionkey as string),
       case r_regionkey % 5 when 3 then 'SELECT nothing_here FROM orders'
         when 4 then 'SELEC * FROM orders'
         else 'SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber > '
              || cast(r_regionkey as string) || ' GROUP BY l_suppkey' end
from {region}
union all
select 'c' || cast(r_regionkey as string),
       case r_regionkey % 3
         when 0 then 'SELECT o_orderkey, 1 / (o_orderkey - o_orderkey) AS x FROM orders'
         when 1 then 'SELECT cast(o_orderstatus AS int) AS x FROM orders'
         else 'DROP TABLE orders' end
from {region}
union all
select 'd' || cast(r_regionkey as string), 'SELECT * FORM orders WHERE' from {region}
"""


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every statement; names resolve in a session of their own."""
    own = spark.newSession()
    shared_folder(spark)
    for name in ("customer", "nation", "orders", "lineitem"):
        load(own, sf_dir, name).createOrReplaceTempView(name)
    outcomes = run_batch(own, derive(own, sf_dir, BATCH), fresh_path(spark, "outcomes"))
    return outcomes.select(
        "instance_id", "success", "n_rows", "error_type", "estimated_seconds"
    )


QUERY_BATCH_SQL = """
select 'a' || r_regionkey as instance_id, true as success, count(c_custkey) as n_rows,
  'none' as error_type, 60 as estimated_seconds
from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
group by r_regionkey
union all
select 'b' || r_regionkey, r_regionkey < 3,
  case when r_regionkey < 3 then (select count(distinct l_suppkey) from lineitem
                                  where l_linenumber > r_regionkey) end,
  case r_regionkey when 3 then 'syntax' when 4 then 'permission' else 'none' end, 60
from region
union all
select 'd' || r_regionkey, false, null, 'syntax', 60
from region
union all
select 'c' || r_regionkey, false, null,
  case when r_regionkey % 3 = 2 then 'permission' else 'runtime' end, 60
from region
"""

QUERIES = {
    "shard_groups": shard_groups,
    "table_names": table_names,
    "column_roster": column_roster,
    "ddl_budget_cut": ddl_budget_cut,
    "doc_toc": doc_toc,
    "doc_truncate": doc_truncate,
    "questions_normalised": questions_normalised,
    "prompt_table": prompt_table,
    "query_batch": query_batch,
}
ORACLES = {
    "shard_groups": SHARD_GROUPS_SQL,
    "table_names": TABLE_NAMES_SQL,
    "column_roster": COLUMN_ROSTER_SQL,
    "ddl_budget_cut": DDL_BUDGET_CUT_SQL,
    "doc_toc": DOC_TOC_SQL,
    "doc_truncate": DOC_TRUNCATE_SQL,
    "questions_normalised": QUESTIONS_SQL,
    "prompt_table": PROMPT_TABLE_SQL,
    "query_batch": QUERY_BATCH_SQL,
}
