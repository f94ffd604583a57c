"""Registered queries over files: derived rows are written in the layout that users bring,
read back by the sources, and must give what the rows themselves give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import grading as G
from plumbline.plans import context, grading
from plumbline.session import fresh_path
from plumbline.sources import csv_records, packed_results, questions, shards
from plumbline.sources.tables import derive, plain


def _lines(rows: DataFrame, path: str, *fields: str) -> None:
    rows.select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)


def questions_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "questions")
    _lines(derive(spark, sf_dir, context.QUESTIONS), path, *questions.QUESTION_FIELDS)
    return questions.read_questions(spark, path).select(
        "instance_id", "nlq", "db_id", "external_knowledge"
    )


def _standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standards of the graded instances, from a file; ids are named like the files."""
    path = fresh_path(spark, "standards")
    rows = derive(spark, sf_dir, grading.MULTI_STANDARD).select(
        F.concat(F.lit("inst="), "instance_id").alias("instance_id"),
        F.from_json("condition_cols_raw", "variant").alias("condition_cols"),
        "ignore_order",
    )
    _lines(rows, path, "instance_id", "condition_cols", "ignore_order")
    return questions.read_standards(spark, path)


def standards_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standards(spark, sf_dir).drop("pos")


STANDARDS_SQL = plain(
    f"""select 'inst=' || instance_id as instance_id, ignore_order,
  replace(condition_cols_raw, ' ', '') as condition_cols_raw from ({grading.MULTI_STANDARD})"""
)


def _stored(rows: DataFrame, columns: list[str], path: str, variant: str | None = None) -> None:
    named = rows.withColumn("inst", F.concat(F.lit("inst="), F.col("inst").cast("string")))
    records = packed_results.records_of(named, "inst", "pos", columns, variant)
    packed_results.store(path, 0, records, packed_results.headers_of(records, columns))


def grade_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every instance, with predictions and golds from packed stores and standards
    from a file."""
    predicted, golds = fresh_path(spark, "predicted"), fresh_path(spark, "golds")
    _stored(derive(spark, sf_dir, grading.MULTI_PRED), grading.PREDICTED_COLUMNS, predicted)
    _stored(
        derive(spark, sf_dir, grading.MULTI_GOLD), grading.GOLD_TABLE_COLUMNS, golds, "variant"
    )
    gold_tables, gold_cells = packed_results.read(spark, golds)
    grades = G.grade(
        _standards(spark, sf_dir),
        *packed_results.read(spark, predicted),
        gold_tables.drop("read_error"),
        gold_cells,
    )
    return G.per_instance(grades)


def quoted_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as one CSV result, with commas, quotes and line ends in its values,
    and read back by byte ranges."""
    path = fresh_path(spark, "quoted")
    docs = derive(spark, sf_dir, "select doc_id, text, lang, source from {documents}")
    docs.write.option("header", True).option("escape", '"').csv(f"{path}/documents.csv")
    records, _ = csv_records.read_records(spark, path)
    value = F.col("values")
    return records.where("i > 1").select(
        value[0].cast("bigint").alias("doc_id"),
        F.length(value[1]).cast("bigint").alias("n_chars"),
        F.md5(value[1]).alias("text_md5"),
        value[2].alias("lang"),
        value[3].alias("source"),
    )


QUOTED_SQL = """select doc_id, length(text) as n_chars, md5(text) as text_md5, lang, source
from documents"""

OLD_SHARDS = "20240115"  # shards before this day were written without their parameters
SHARDED = "select date_format(ts, 'yyyyMMdd') as shard, event_type, value, props from {events}"


def shards_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day shards written as folders, older ones without a column, of which those with more than a
    fifth of errors are read."""
    path = fresh_path(spark, "shards")
    rows = derive(spark, sf_dir, SHARDED)
    shards.write_shards(rows.where(F.col("shard") < OLD_SHARDS).drop("props"), path, "shard")
    shards.write_shards(rows.where(F.col("shard") >= OLD_SHARDS), path, "shard", "append")
    errors = rows.groupBy("shard").agg(
        (F.count_if(F.col("event_type") == "error") * 5 > F.count(F.lit(1))).alias("many")
    )
    chosen = shards.listed_shards(shards.read_shards(spark, path, "shard"), "shard", errors.where("many"))
    return chosen.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("props").alias("n_props"),
        F.round(F.sum("value"), 2).alias("total_value"),
    )


SHARDS_SQL = f"""
select strftime(ts, '%Y%m%d') as shard, count(*) as n_events,
  case when strftime(ts, '%Y%m%d') < '{OLD_SHARDS}' then 0 else count(props) end as n_props,
  round(sum(value), 2) as total_value
from events group by strftime(ts, '%Y%m%d')
having count(*) filter (event_type = 'error') * 5 > count(*)
"""

# There are no unreadable files among them: those results are absent.
GRADE_SQL = f"""
select 'inst=' || instance_id as instance_id,
  case status when 'execution_error' then 'missing' else status end as status
from ({grading.GRADE_STATUS_SQL})
"""

QUERIES = {
    "questions_from_files": questions_from_files,
    "standards_from_files": standards_from_files,
    "grade_from_files": grade_from_files,
    "quoted_csv_records": quoted_csv_records,
    "shards_with_errors": shards_with_errors,
}
ORACLES = {
    "questions_from_files": context.QUESTIONS_SQL,
    "standards_from_files": STANDARDS_SQL,
    "grade_from_files": GRADE_SQL,
    "quoted_csv_records": QUOTED_SQL,
    "shards_with_errors": SHARDS_SQL,
}
