"""The training-data pipeline: quality rules, near duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written and read
again as the next stage's documents. All but the last return the columns of ``documents``.

ORACLE_SQL is None: SQL cannot express the tokenizer, the bit-parallel distance and best-fit packing. The tests hold the
stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontamination, ngram_join, packing, quality_rules, secrets
from flowlens.llm.catalog import SEQUENCE_TOKENS, tokenizer_path
from flowlens.llm.tables import read, written

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep."""
    return quality_rules.passing(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id; documents without words stay."""
    return ngram_join.representatives(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` follows the new text."""
    marked = secrets.redacted(docs)
    return marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else marked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their training sequence and place."""
    return packing.pack_documents(docs, tokenizer_path(), SEQUENCE_TOKENS, end_id=2)


STAGES = [("quality_rules", quality_stage), ("ngram_join", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("secret_scans", secrets_stage), ("best_fit_packing", packing_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
