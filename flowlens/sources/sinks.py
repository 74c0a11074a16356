"""S4: instance embeddings. Tables and documents of runs are in ``sources.runs``, the log in ``sources.response_log``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.sources.embeddings import vector_text

def write_embeddings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S4: instance embeddings; CSV keeps the vector as list text."""
    if fmt == "csv":
        df.withColumn("embedding", vector_text(F.col("embedding"))) \
          .write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
