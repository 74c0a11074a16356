"""S12: the append-only log of prompts and answers, and the questions a restarted job asks of it.

    <path>/run_id=<run>/batch=<b>/*.parquet      (item_id, prompt, generated_text, timestamp, attempt)

A batch's answers appear together when its job commits; a killed job leaves none of a batch. Rows are never rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import RESPONSE_LOG
from flowlens.sources.results import path_missing


def item_id(id_cols: list[str]) -> Column:
    """One text for an item's key: the value itself for a single column, else the values as JSON."""
    return F.col(id_cols[0]).cast("string") if len(id_cols) == 1 else F.to_json(F.struct(*id_cols), {"ignoreNullFields": "false"})


def batch_of(item: Column, batches: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(batches)).cast("int")


def append_answers(rows: DataFrame, path: str, run_id: str) -> None:
    """Append (item_id, prompt, generated_text, batch) of one run."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    (rows.select("item_id", "prompt", "generated_text", now.alias("timestamp"), F.lit(uuid.uuid4().hex).alias("attempt"),
                 F.lit(run_id).alias("run_id"), "batch")
     .write.mode("append").partitionBy("run_id", "batch").parquet(path))


def append_response_log(df: DataFrame, path: str, run_id: str, item_col: str = "workflow_id") -> None:
    """Append (prompt, generated_text) rows that were answered elsewhere, as one batch."""
    append_answers(df.select(F.col(item_col).cast("string").alias("item_id"), "prompt", "generated_text", F.lit(0).alias("batch")), path, run_id)


def read_response_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty table when there is none."""
    try:
        return spark.read.schema(RESPONSE_LOG).parquet(path)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return spark.createDataFrame([], RESPONSE_LOG)


def unanswered(prompts: DataFrame, path: str, run_id: str, batch: int) -> DataFrame:
    """The prompts (item_id, prompt, batch) of one batch that the run's log has no answer to. An answer counts only for
    the same prompt text, so a changed prompt is asked again."""
    log = read_response_log(prompts.sparkSession, path).where((F.col("run_id") == run_id) & (F.col("batch") == batch))
    return prompts.where(F.col("batch") == batch).join(log.select("item_id", "prompt"), ["item_id", "prompt"], "left_anti")


def answers(prompts: DataFrame, path: str, run_id: str) -> DataFrame:
    """(item_id, prompt, generated_text, n_logged): exactly one answer a prompt, the first that was logged."""
    log = read_response_log(prompts.sparkSession, path).where(F.col("run_id") == run_id)
    order = F.struct("timestamp", "attempt", "generated_text")
    first = log.groupBy("item_id", "prompt").agg(F.min(order).alias("a"), F.count(F.lit(1)).alias("n_logged"))
    found = first.select("item_id", "prompt", F.col("a.generated_text").alias("generated_text"), "n_logged")
    return prompts.select("item_id", "prompt").join(found, ["item_id", "prompt"])
