"""S8, S9, S11: the JSON documents of runs, built as ordered lines.

A document is a table of lines (domain, task, model, file, part, place, line): ``part`` 0 opens it, 1 holds one record
a line, 2 closes it. Lines are brought together by run and streamed into the run's file in order, so a document of any
length is written without ever being one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ("domain", "task", "model")
LINE = ("file", "part", "place", "line")


def json_text(name: str) -> Column:
    """A text column as a JSON string: the one-element array without its brackets."""
    array = F.to_json(F.array(name))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def edge(runs: DataFrame, file: str, part: int, line: str | Column) -> DataFrame:
    text = F.lit(line) if isinstance(line, str) else line
    return runs.select(*RUN, F.lit(file).alias("file"), F.lit(part).alias("part"), F.lit("").alias("place"), text.alias("line"))


def record_lines(rows: DataFrame, file: str, place: str, record: Column) -> DataFrame:
    """One line a row, a comma before every record but the run's first by ``place``."""
    ordered = rows.select(*RUN, F.coalesce(F.col(place).cast("string"), F.lit("")).alias("place"), F.to_json(record).alias("json"))
    first = ordered.groupBy(*RUN).agg(F.min(F.struct("place", "json")).alias("first"))      # one row a run
    lead = F.when(F.struct("place", "json") == F.col("first"), "").otherwise(",")
    return ordered.join(first, list(RUN)).select(*RUN, F.lit(file).alias("file"), F.lit(1).alias("part"), "place", F.concat(lead, "json").alias("line"))


def report_document(report_rows: DataFrame) -> DataFrame:
    """S8 ``report.json``: label -> {precision, recall, f1-score, support}; one line a label."""
    text = F.concat(json_text("label"), F.lit(": "), F.to_json(F.struct(
        "precision", "recall", F.col("f1_score").alias("f1-score"), F.col("support").cast("double").alias("support"))))
    rows = report_rows.select(*RUN, F.lit("report.json").alias("file"), F.lit(1).alias("part"), F.col("label").alias("place"), text.alias("line"))
    return keyed(rows, "report.json")


def confusion_document(grid: DataFrame) -> DataFrame:
    """S9 ``confusion_matrix.json``: predicted -> actual -> count over the whole grid; one line a predicted class."""
    inner = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("actual").alias("key"), F.col("n").alias("value")))))
    rows = grid.groupBy(*RUN, "predicted").agg(inner.alias("counts"))       # one row holds one class's counts
    text = F.concat(json_text("predicted"), F.lit(": "), F.to_json("counts"))
    return keyed(rows.select(*RUN, F.lit("confusion_matrix.json").alias("file"), F.lit(1).alias("part"), F.col("predicted").alias("place"),
                             text.alias("line")), "confusion_matrix.json")


def keyed(rows: DataFrame, file: str) -> DataFrame:
    """``key: value`` lines as one JSON object."""
    first = rows.groupBy(*RUN).agg(F.min("place").alias("first"))
    lines = rows.join(first, list(RUN)).withColumn("line", F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), "line"))
    runs = rows.select(*RUN).distinct()
    return lines.select(*RUN, *LINE).unionByName(edge(runs, file, 0, "{")).unionByName(edge(runs, file, 2, "}"))


def detailed_document(detailed: DataFrame) -> DataFrame:
    """S10 ``detailed_results.json``: an array of {workflow_id, true_class, predicted_class, correct}, by workflow id."""
    record = F.struct("workflow_id", "true_class", "predicted_class", "correct")
    runs = detailed.select(*RUN).distinct()
    file = "detailed_results.json"
    return (record_lines(detailed, file, "workflow_id", record)
            .unionByName(edge(runs, file, 0, "[")).unionByName(edge(runs, file, 2, "]")))


def segmentation_document(results: DataFrame, aggregates: DataFrame | None = None) -> DataFrame:
    """S11 ``segmentation_results.json``: individual results, one line a sequence, and the run's aggregates.

    A run that is absent from ``aggregates`` has none in its document (None: all runs are without).
    """
    file = "segmentation_results.json"
    seg = "array<struct<start_index:bigint,end_index:bigint>>"
    true_segs = F.transform(F.col("true_starts"), lambda s, i: F.struct(
        s.alias("start_index"),
        (F.coalesce(F.try_element_at(F.col("true_starts"), i + 2), F.col("sequence_length")) - 1).alias("end_index")))
    record = F.struct("sequence_id", "num_workflows", "sequence_length", "boundary_precision", "boundary_recall", "boundary_f1",
                      "edit_distance", true_segs.cast(seg).alias("true_segments"), F.col("pred_segments").cast(seg).alias("pred_segments"))
    runs = results.select(*RUN).distinct()
    lines = record_lines(results, file, "sequence_id", record).unionByName(edge(runs, file, 0, '{"individual_results": ['))
    if aggregates is None:
        return lines.unionByName(edge(runs, file, 2, "]}"))
    stored = F.to_json(F.struct("boundary_precision", "boundary_recall", "boundary_f1", F.col("edit_distance").cast("double").alias("edit_distance")))
    stored = aggregates.select(*RUN, stored.alias("stored"))
    end = F.when(F.col("stored").isNull(), "]}").otherwise(F.concat(F.lit('], "aggregate_metrics": '), "stored", F.lit("}")))
    return lines.unionByName(edge(runs.join(stored, list(RUN), "left"), file, 2, end))


def write_documents(lines: DataFrame, root: str) -> None:
    """Write documents as <root>/domain=/task=/model=/file=<name>/: all lines of one document in one file, in order."""
    by = [*RUN, "file"]
    (lines.select(*by, "part", "place", "line").repartition(*by).sortWithinPartitions(*by, "part", "place", "line")
     .select(*by, "line").write.mode("append").partitionBy(*by).text(root))
