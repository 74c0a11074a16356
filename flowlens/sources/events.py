"""S1: interaction events. A JSON array file is not splittable, so it is read once and landed as
Parquet (partitioned by domain); every later job reads the landed table.

File order is kept over any number of files. Landing stores where each row came from: its file, the block of the file
that a task read, and the row's running number in that task. Rows of a block are read in order by one task, so within a
block the running number is the position plus a constant; blocks follow each other by file name and block start. The
landed table fixes these numbers, and ``read_landed`` turns them into ``event_seq`` with one small row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.schemas import EVENT

ORIGIN = ("source_file", "block_start", "read_id")


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read events with the declared schema. fmt: 'json' (a JSON array per file), 'jsonl', 'parquet'.

    Adds ``domain`` (the file name without extension, e.g. hr.json -> hr) where it is missing and, for rows without an
    ``event_seq`` of their own, their origin (``ORIGIN``). The origin holds for one reading; land the rows to keep it.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(EVENT).option("multiLine", fmt == "json").json(path)
    if "domain" not in df.columns:
        df = df.withColumn("domain", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1))
    if "event_seq" not in df.columns:
        df = (df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("block_start", F.col("_metadata.file_block_start"))
              .withColumn("read_id", F.monotonically_increasing_id()))
    return df


def land_events(spark: SparkSession, src: str, dst: str, fmt: str = "json", domain: F.Column | None = None) -> DataFrame:
    """Read once and write Parquet partitioned by domain (so later scans prune by domain). ``domain`` replaces the one
    taken from file names, where files hold several domains."""
    df = read_events(spark, src, fmt)
    if domain is not None:
        df = df.withColumn("domain", domain)
    df.write.mode("overwrite").partitionBy("domain").parquet(dst)
    return read_landed(spark, dst)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """The landed events with ``event_seq``: gap-free from 0 in order of file, block and position."""
    rows = spark.read.parquet(path)
    if "event_seq" in rows.columns:
        return rows
    blocks = rows.groupBy("source_file", "block_start").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first"))
    before = Window.orderBy("source_file", "block_start").rowsBetween(Window.unboundedPreceding, -1)     # one row a block read
    starts = blocks.select("source_file", "block_start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (rows.join(starts, ["source_file", "block_start"])
            .withColumn("event_seq", (F.col("start") + F.col("read_id") - F.col("first")).cast("bigint"))
            .drop(*ORIGIN, "start", "first"))
