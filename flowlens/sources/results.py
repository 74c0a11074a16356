"""S5-S7: scan result trees and read their documents into long tables.

Two layouts: "tree", files <root>/<domain>/<task>/<model>/<file>.json as other tools write them, and "exported",
<root>/domain=<d>/task=<t>/model=<m>/file=<file>.json/ as ``documents.write_documents`` writes them. Domain, task and model
come from the path. A document is parsed to VARIANT once and its records are exploded out of it one by one, so no typed
array of a whole run is built. Missing files contribute no rows; a file that is not JSON is an error.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PATH = r"^.*/([^/]+)/([^/]+)/([^/]+)/[^/]+$"
RUN_COLUMNS = "domain string, task string, model string"
RUN = ("domain", "task", "model")
SEGMENTS = "array<struct<start_index:bigint,end_index:bigint>>"


def path_missing(error: AnalysisException) -> bool:
    """Nothing lies at the path (no such path, or a folder without files); other failures are not "no data"."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _from_path(path: Column) -> list[Column]:
    """Domain, task and model of a file path; what the file system escapes in a URL is written plainly."""
    return [F.try_url_decode(F.replace(F.regexp_extract(path, _PATH, i + 1), F.lit("+"), F.lit("%2B"))).alias(c) for i, c in enumerate(RUN)]


def _whole(spark: SparkSession, root: str, name: str, layout: str = "tree") -> DataFrame | None:
    """(domain, task, model, value) of every document called ``name``."""
    try:
        if layout == "exported":
            docs = spark.read.schema(f"value string, {RUN_COLUMNS}, file string").text(root, wholetext=True)
            return docs.where(F.col("file") == name).select(*RUN, "value")
        return spark.read.text(f"{root}/*/*/*/{name}", wholetext=True).select(*_from_path(F.col("_metadata.file_path")), "value")
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return None


def scan_results(spark: SparkSession, root: str, layout: str = "tree") -> DataFrame:
    """(domain, task, model, file) for every result file; the files themselves are not opened."""
    if layout == "exported":
        return (spark.read.schema(f"value string, {RUN_COLUMNS}, file string").text(root)
                .select(*RUN, "file", "_metadata.file_path").distinct().select(*RUN, "file"))
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/*/*/*")
    path = F.col("_metadata.file_path")
    return df.select(*_from_path(path), F.regexp_extract(path, r"([^/]+)$", 1).alias("file"))


def exploded(docs: DataFrame, path: str = "$") -> DataFrame:
    """(domain, task, model, key, value: variant): one row for every element or entry at ``path`` of each document."""
    parsed = docs.select(*RUN, F.variant_get(F.parse_json("value"), path, "variant").alias("doc"))
    records = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return records.select(*RUN, "key", "value")


def _field(name: str, kind: str) -> Column:
    return F.variant_get("value", f"$['{name}']", kind).alias(name)


def detailed_rows(docs: DataFrame) -> DataFrame:
    fields = [_field(c, "string") for c in ("workflow_id", "true_class", "predicted_class")]
    return exploded(docs).select(*RUN, *fields, _field("correct", "boolean"))


def report_rows(docs: DataFrame) -> DataFrame:
    numbers = [F.variant_get("value", f"$['{c}']", "double").alias(c.replace("f1-score", "f1_score")) for c in ("precision", "recall", "f1-score", "support")]
    return exploded(docs).select(*RUN, F.col("key").alias("label"), *numbers)


def confusion_cells(docs: DataFrame) -> DataFrame:
    """The file's outer key is the predicted class."""
    outer = exploded(docs).select(*RUN, F.col("key").alias("predicted"), F.col("value").alias("doc"))
    inner = outer.lateralJoin(outer.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return inner.select(*RUN, F.col("key").alias("actual"), "predicted", F.variant_get("value", "$", "bigint").alias("n"))


def individual_rows(docs: DataFrame) -> DataFrame:
    numbers = [_field(c, "double") for c in ("boundary_precision", "boundary_recall", "boundary_f1")]
    return exploded(docs, "$.individual_results").select(
        *RUN, _field("sequence_id", "string"), _field("num_workflows", "bigint"), _field("sequence_length", "bigint"), *numbers,
        _field("edit_distance", "bigint"), _field("true_segments", SEGMENTS), _field("pred_segments", SEGMENTS))


def stored_aggregates(docs: DataFrame) -> DataFrame:
    """Runs whose document holds aggregate metrics (any may be null); runs without are absent."""
    metrics = docs.select(*RUN, F.variant_get(F.parse_json("value"), "$.aggregate_metrics", "variant").alias("value"))
    names = ("boundary_precision", "boundary_recall", "boundary_f1", "edit_distance")
    return metrics.where(F.col("value").isNotNull()).select(*RUN, *[_field(c, "double") for c in names])


def load_detailed(spark: SparkSession, root: str, layout: str = "tree") -> DataFrame | None:
    docs = _whole(spark, root, "detailed_results.json", layout)
    return None if docs is None else detailed_rows(docs)


def load_reports(spark: SparkSession, root: str, layout: str = "tree") -> DataFrame | None:
    """Long report rows (domain, task, model, label, precision, recall, f1_score, support)."""
    docs = _whole(spark, root, "report.json", layout)
    return None if docs is None else report_rows(docs)


def load_confusion(spark: SparkSession, root: str, layout: str = "tree") -> DataFrame | None:
    """(domain, task, model, actual, predicted, n)."""
    docs = _whole(spark, root, "confusion_matrix.json", layout)
    return None if docs is None else confusion_cells(docs)


def load_segmentation(spark: SparkSession, root: str, layout: str = "tree") -> tuple[DataFrame, DataFrame] | None:
    """(individual results, stored aggregates); see reporting.segmentation_fallback."""
    docs = _whole(spark, root, "segmentation_results.json", layout)
    return None if docs is None else (individual_rows(docs), stored_aggregates(docs))
