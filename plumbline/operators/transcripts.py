"""Whole exploration transcripts: the column roster, the steps, and where the agent was ready."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import sql_text as S
from plumbline.functions import text as T
from plumbline.operators import prompts as P
from plumbline.operators.catalogue import budgeted_text


def transcripts(
    instances: DataFrame, steps: DataFrame, rosters: DataFrame, budget: int, query_budget: int
) -> DataFrame:
    """instance_id, transcript of every instance (instance_id, db_id).

    ``steps`` (instance_id, step, ready, sql, success, n_rows, rows_json, message) are shown in
    their order up to the first ready one, which closes the transcript; ``rosters`` (db_id,
    roster) come before them. Texts are cut to the budget before they are joined, since nothing
    beyond it can be shown. Instances without steps, database or roster have the rest.
    """
    ready = F.coalesce("ready", F.lit(False))
    closed = steps.where(ready).groupBy("instance_id").agg(F.min("step").alias("_last"))
    result = P.result_text(F.col("success"), F.col("n_rows"), F.col("rows_json"), F.col("message"))
    sql = F.col("sql")
    query = P.step_block(S.capped(sql), S.is_uncapped_select(sql), result, query_budget)
    blocks = (
        steps.join(closed, "instance_id", "left")
        .where("_last IS NULL OR step <= _last")
        .select("instance_id", "step", F.when(ready, P.READY_NOTE).otherwise(query).alias("block"))
    )
    room = budget - len(P.TRANSCRIPT_HEAD)
    told = budgeted_text(blocks, "instance_id", "step", "block", room).select("instance_id", "head")
    known = rosters.select("db_id", F.left("roster", F.lit(budget + 1)).alias("roster"))
    whole = F.concat(
        F.lit(P.TRANSCRIPT_HEAD),
        F.coalesce("roster", F.lit("")),
        F.coalesce("head", F.lit("")),
    )
    return (
        instances.select("instance_id", "db_id")
        .join(known, "db_id", "left")
        .join(told, "instance_id", "left")
        .select("instance_id", T.truncate(whole, budget, T.TRANSCRIPT_TRUNCATED).alias("transcript"))
    )
