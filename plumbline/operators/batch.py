"""A table of SQL texts run as Spark queries, their outcomes kept as a table."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import errors as E
from plumbline.functions import sql_text as S
from plumbline.sources.result_csv import store_result

OUTCOME_SCHEMA = (
    "instance_id STRING, success BOOLEAN, n_rows BIGINT, error_message STRING, "
    "sqlstate STRING, execution_time_ms BIGINT, estimated_seconds INT"
)
#: Fixed value: message of a statement that is not one of reading.
NOT_READ_ONLY = "Only read-only statements are allowed"
PERMISSION_STATE = "42501"


def _run_one(spark: SparkSession, row, results: str | None):
    started = time.monotonic()
    n_rows = message = state = None
    if not row["read_only"]:
        message, state = NOT_READ_ONLY, PERMISSION_STATE
    else:
        try:
            # Every column is evaluated, and counted on the way; no row reaches the driver.
            seen = Observation()
            result = spark.sql(row["run_sql"]).observe(seen, F.count(F.lit(1)).alias("n"))
            if results and row["instance_id"] is not None:
                store_result(spark, results, row["instance_id"], row["run_sql"], result)
            else:
                result.write.format("noop").mode("overwrite").save()
            n_rows = seen.get["n"]
        except PySparkException as error:
            message, state = str(error).strip(), error.getSqlState()
    elapsed = int((time.monotonic() - started) * 1000)
    done = row["instance_id"], message is None, n_rows, message, state, elapsed
    return *done, row["estimated_seconds"]


def run_batch(
    spark: SparkSession,
    texts: DataFrame,
    outcomes: str,
    results: str | None = None,
    chunk: int = 500,
    at_once: int = 4,
) -> DataFrame:
    """Run every text (``instance_id``, ``sql``) as a normal Spark query, a few at a time.

    Texts reach the driver one partition at a time; result rows never do. Statements that do
    not only read are refused. The table ``outcomes`` is replaced and then grows in chunks; the
    error kind follows the SQLSTATE, and the message where there is none. Repeated and NULL ids
    are texts of their own, with one outcome each; a result without an id is not stored.
    """
    cleaned = texts.select(
        "instance_id",
        S.runnable(F.col("sql")).alias("run_sql"),
        S.is_read_only(S.runnable(F.col("sql"))).alias("read_only"),
        S.estimated_seconds(F.col("sql")).alias("estimated_seconds"),
    )
    spark.createDataFrame([], OUTCOME_SCHEMA).write.mode("overwrite").parquet(outcomes)
    with ThreadPoolExecutor(at_once) as pool:
        for rows in batched(cleaned.toLocalIterator(), chunk):
            done = list(pool.map(lambda row: _run_one(spark, row, results), rows))
            spark.createDataFrame(done, OUTCOME_SCHEMA).write.mode("append").parquet(outcomes)
    ran = spark.read.schema(OUTCOME_SCHEMA).parquet(outcomes)
    kind = E.execution_kind(F.col("success"), F.col("error_message"), F.col("sqlstate"))
    return ran.select(
        *[c for c in ran.columns if c != "estimated_seconds"],
        kind.alias("error_type"),
        "estimated_seconds",
    )
