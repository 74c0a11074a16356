"""The run store: Parquet tables and JSON documents of runs, switched together by one commit record.

    <root>/tables/<name>/attempt=<id>/domain=<d>/task=<t>/model=<m>/*.parquet
    <root>/documents/attempt=<id>/domain=<d>/task=<t>/model=<m>/file=<name>.json/*.txt
    <root>/commits/*.parquet           (domain, task, model, attempt, version)

Every write is a new attempt beside the old ones; nothing is replaced in place. Only when all of its tables and documents
are there does one small file with a row for each run name the attempt. Readers take the newest attempt of each run, so
a run is seen whole, old or new, and what a lost or killed job left behind is never read. Attempt and run are partition
columns: readers prune to the committed folders.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.documents import write_documents
from flowlens.sources.results import RUN_COLUMNS, path_missing

RUN = ("domain", "task", "model")
COMMITS = f"{RUN_COLUMNS}, attempt string, version bigint"


def model_dir(model_col: str = "model") -> F.Column:
    """S13: a model goes by its name after the last '/', in tables, documents and commit records alike."""
    return F.substring_index(F.col(model_col), "/", -1)


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("model", model_dir())


def commits(spark: SparkSession, root: str) -> DataFrame:
    """All commit records, an empty table where there is none."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return spark.createDataFrame([], COMMITS)


def current_runs(spark: SparkSession, root: str) -> DataFrame:
    """(domain, task, model, attempt, version) of the newest committed attempt of every run."""
    newest = commits(spark, root).groupBy(*RUN).agg(F.max(F.struct("version", "attempt")).alias("c"))
    return newest.select(*RUN, "c.attempt", "c.version")


def stage_runs(root: str, tables: dict[str, DataFrame], documents: list[DataFrame] | None = None) -> str:
    """Write a new attempt and return its id. Without a commit it is not read."""
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        (named(df).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt", *RUN)
         .parquet(f"{root}/tables/{name}"))
    for lines in documents or []:
        write_documents(named(lines), f"{root}/documents/attempt={attempt}")
    return attempt


def commit_runs(root: str, runs: DataFrame, attempt: str) -> None:
    """Make ``attempt`` the current one of ``runs`` (domain, task, model): one file, so all runs switch at once."""
    spark = runs.sparkSession
    version = (commits(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    record = named(runs.select(*RUN)).distinct().withColumn("attempt", F.lit(attempt)).withColumn("version", F.lit(version).cast("bigint"))
    record.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def write_runs(root: str, runs: DataFrame, tables: dict[str, DataFrame], documents: list[DataFrame] | None = None) -> str:
    """Write tables and documents of ``runs`` and switch to them. Other runs in the store stay as they are."""
    attempt = stage_runs(root, tables, documents)
    commit_runs(root, runs, attempt)
    return attempt


def read_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame | None:
    """The committed rows of a table (``schema`` without the run columns), None where no run has it."""
    try:
        rows = spark.read.schema(f"{schema}, attempt string, {RUN_COLUMNS}").parquet(f"{root}/tables/{name}")
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return None
    committed = rows.join(current_runs(spark, root).select("attempt", *RUN), ["attempt", *RUN], "left_semi")
    return committed.select(*RUN, *[c for c in rows.columns if c not in (*RUN, "attempt")])


def read_documents(spark: SparkSession, root: str, file: str) -> DataFrame | None:
    """(domain, task, model, value): the committed documents of one name, each whole."""
    schema = f"value string, attempt string, {RUN_COLUMNS}, file string"
    try:
        docs = spark.read.schema(schema).text(f"{root}/documents", wholetext=True)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return None
    current = current_runs(spark, root).select("attempt", *RUN)
    return docs.where(F.col("file") == file).join(current, ["attempt", *RUN], "left_semi").select(*RUN, "value")
