"""S3: instance embeddings stored as CSV with the vector as list text ('[0.1, -0.2, ...]')."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.schemas import EMBEDDING_CSV


def parse_vector_text(c) -> F.Column:
    """'[0.1, 0.2]' -> array<double> (JSON parse, never eval)."""
    return F.from_json(c, "array<double>")


def read_embedding_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.schema(EMBEDDING_CSV).option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    return raw.withColumn("embedding", parse_vector_text(F.col("embedding")))


def vector_text(c) -> F.Column:
    """array<double> -> '[0.1, 0.2]' (CSV export)."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
