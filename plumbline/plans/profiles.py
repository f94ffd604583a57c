"""Registered queries that describe tables: paths of JSON texts, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.inventory import path_inventory
from plumbline.sources.sizes import parquet_sizes
from plumbline.sources.tables import TABLES, derive, plain

# One nested text per event: its parameters, a list of mixed kinds, and a field whose kind
# depends on the event; some are missing or no JSON.
NESTED = """
select translate(case when event_id % 97 = 5 then null
  when event_id % 89 = 7 then 'k=' || cast(event_id as string)
  else '<"props":' || coalesce(props, 'null') || ',"type":"' || coalesce(event_type, '')
    || '","list":[' || cast(event_id as string) || ',"x",<"v":null,"w":[true,[2.25]]>]'
    || ',"mixed":' || case event_id % 4 when 0 then '"t"' when 1 then '<"deep":<"er":[1]>>'
      when 2 then '[]' else cast(user_id as string) || '.5' end || '>' end,
  '<>', chr(123) || chr(125)) as doc
from {events}
"""


def json_path_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of the nested texts, with the kinds of its values and their counts."""
    return path_inventory(derive(spark, sf_dir, NESTED), F.col("doc"))


INVENTORY_SQL = plain(
    f"""
with t as (select doc from ({NESTED}) where doc is not null),
tree as (
  select regexp_replace(j.fullkey, '\\[\\d+\\]', '[*]', 'g') as path,
    case j.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'text'
      when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'DOUBLE' then 'decimal'
      else 'integer' end as kind
  from (select doc from t where json_valid(doc)) v, json_tree(v.doc) j)
select path, kind, count(*) as n_values from tree group by path, kind
union all
select '$', 'no json', count(*) from t where not json_valid(doc) having count(*) > 0
"""
)


def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and rows of the given tables, from footers."""
    sizes = parquet_sizes(spark, {name: f"{sf_dir}/{name}.parquet" for name in TABLES})
    return sizes.select("table_name", "n_columns", "n_rows")


SIZES_SQL = " union all ".join(
    f"select '{name}' as table_name, cast((select count(*) from (describe {name})) as integer) "
    f"as n_columns, (select count(*) from {name}) as n_rows"
    for name in TABLES
)

QUERIES = {"json_path_inventory": json_path_inventory, "table_sizes": table_sizes}
ORACLES = {"json_path_inventory": INVENTORY_SQL, "table_sizes": SIZES_SQL}
