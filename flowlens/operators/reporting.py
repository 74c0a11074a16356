"""Cross-run reporting: roll-ups over results of many (domain, task, model) runs.

Inputs are the long result tables (detailed results, report rows, segmentation results), either
produced directly by the evaluation operators or read back from a result tree
(sources.results). All roll-ups are small aggregates; the plot data of every figure is one of
these tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.text import safe_div

RUN = ("domain", "task", "model")


def run_accuracy(detailed: DataFrame, keys=RUN) -> DataFrame:
    """Correct / incorrect / total / accuracy per run (a missing correct flag counts as false)."""
    c = F.coalesce(F.col("correct"), F.lit(False))
    return (detailed.groupBy(*keys)
            .agg(F.count_if(c).alias("correct"), F.count(F.lit(1)).alias("total"))
            .withColumn("incorrect", F.col("total") - F.col("correct"))
            .withColumn("accuracy", safe_div("correct", "total")))


def class_accuracy(detailed: DataFrame, keys=RUN) -> DataFrame:
    """Per run and true class (null -> 'Unknown'), ranked by ascending accuracy (ties by name)."""
    c = F.coalesce(F.col("correct"), F.lit(False))
    r = (detailed.groupBy(*keys, F.coalesce("true_class", F.lit("Unknown")).alias("true_class"))
         .agg(F.count_if(c).alias("correct"), F.count(F.lit(1)).alias("total"))
         .withColumn("incorrect", F.col("total") - F.col("correct"))
         .withColumn("accuracy", safe_div("correct", "total")))
    w = Window.partitionBy(*keys).orderBy("accuracy", "true_class")  # one partition = classes of one run
    return r.withColumn("rank", F.row_number().over(w))


def accuracy_rollup(detailed: DataFrame, keys=RUN) -> DataFrame:
    """Accuracy by run, by run and true class, and by domain and model (classification tasks only), in one pass.

    ``level`` is 'run', 'class' or 'domain'; columns that a level sums over are null. One aggregate with grouping sets:
    rows are combined before the shuffle, and a row is read once for all three levels.
    """
    named = detailed.select(*keys, F.coalesce("true_class", F.lit("Unknown")).alias("true_class"),
                            F.coalesce("correct", F.lit(False)).alias("correct"))
    of_class = F.col("task").contains("classification")
    levels = [[*keys, "true_class"], [*keys], ["domain", "model"]]
    counted = named.groupingSets(levels, *keys, "true_class").agg(
        F.grouping("task").alias("no_task"), F.grouping("true_class").alias("no_class"),
        F.count_if("correct").alias("all_correct"), F.count(F.lit(1)).alias("all_rows"),
        F.count_if(F.col("correct") & of_class).alias("class_correct"), F.count_if(of_class).alias("class_rows"))
    domain = F.col("no_task") == 1
    level = F.when(domain, "domain").when(F.col("no_class") == 1, "run").otherwise("class")
    total = F.when(domain, F.col("class_rows")).otherwise(F.col("all_rows"))
    right = F.when(domain, F.col("class_correct")).otherwise(F.col("all_correct"))
    return (counted.select(level.alias("level"), *keys, "true_class", right.alias("correct"), total.alias("total")).where("total > 0")
            .withColumn("incorrect", F.col("total") - F.col("correct")).withColumn("accuracy", safe_div("correct", "total")))


def domain_accuracy(detailed: DataFrame) -> DataFrame:
    """Domain x model accuracy, pooled over that domain's classification tasks."""
    d = detailed.where(F.col("task").contains("classification"))
    c = F.coalesce(F.col("correct"), F.lit(False))
    return (d.groupBy("domain", "model").agg(F.count_if(c).alias("correct"), F.count(F.lit(1)).alias("total"))
            .withColumn("accuracy", safe_div("correct", "total")))


SEGMENTATION_METRICS = ("boundary_precision", "boundary_recall", "boundary_f1", "edit_distance")


def segmentation_fallback(aggregates: DataFrame | None, individual: DataFrame, keys=RUN) -> DataFrame:
    """One row a run, all four metrics from one source: the stored aggregates as they are (nulls too) where the run has
    any, else means of its individual results; a run with neither is absent. ``metrics_source`` says which."""
    means = individual.groupBy(*keys).agg(*[F.avg(c).cast("double").alias(c) for c in SEGMENTATION_METRICS])
    if aggregates is None:
        return means.withColumn("metrics_source", F.lit("recomputed"))
    stored = aggregates.select(*keys, *[F.col(c).cast("double").alias(c) for c in SEGMENTATION_METRICS], F.lit("stored").alias("metrics_source"))
    recomputed = means.join(stored.select(*keys), list(keys), "left_anti").withColumn("metrics_source", F.lit("recomputed"))
    return stored.unionByName(recomputed)


def domain_segmentation_f1(seg_runs: DataFrame) -> DataFrame:
    """Domain x model boundary F1: mean over the domain's segmentation tasks of each run's F1
    (mean of means; runs without F1 skipped)."""
    s = seg_runs.where(F.col("task").contains("segmentation") & F.col("boundary_f1").isNotNull())
    return s.groupBy("domain", "model").agg(F.avg("boundary_f1").alias("boundary_f1"),
                                            F.count(F.lit(1)).alias("n_tasks"))


def reported(report_rows: DataFrame, keys=RUN) -> DataFrame:
    """One row for every run whose report has an 'Average' row: its metrics and, where the report has it, its accuracy.
    A report without 'Average' gives neither."""
    def of(label: str, field: str) -> F.Column:
        return F.max(F.when(F.col("label") == label, F.col(field).cast("double")))

    rows = report_rows.where(F.col("label").isin("accuracy", "Average")).groupBy(*keys).agg(
        of("Average", "precision").alias("precision"), of("Average", "recall").alias("recall"), of("Average", "f1_score").alias("f1"),
        of("Average", "support").alias("support"), of("accuracy", "precision").alias("report_accuracy"),
        F.count_if(F.col("label") == "Average").alias("n_average"))
    return rows.where("n_average > 0").drop("n_average")


def classification_leaderboard(report_rows: DataFrame, detailed: DataFrame, keys=RUN) -> DataFrame:
    """Macro P / R / F1 (the 'Average' row) and accuracy per run: as reported, else recomputed from the detailed results.
    Runs without an Average row have no metrics. One aggregate over each input and their join."""
    rec = run_accuracy(detailed, keys).select(*keys, F.col("accuracy").alias("recomputed_accuracy"))
    source = F.when(F.col("report_accuracy").isNotNull(), "report").when(F.col("recomputed_accuracy").isNotNull(), "detailed")
    return (reported(report_rows, keys).join(rec, list(keys), "full")
            .select(*keys, "precision", "recall", "f1", "support", F.coalesce("report_accuracy", "recomputed_accuracy").alias("accuracy"),
                    source.alias("accuracy_source")))


def accuracy_fallback(report_rows: DataFrame, detailed: DataFrame, keys=RUN) -> DataFrame:
    """Accuracy from the report's 'accuracy' row, else recomputed from detailed results; a run is kept if either exists."""
    board = classification_leaderboard(report_rows, detailed, keys)
    return board.where(F.col("accuracy").isNotNull()).select(*keys, "accuracy", "accuracy_source")


def segmentation_leaderboard(seg_runs: DataFrame, keys=RUN) -> DataFrame:
    """Boundary P / R / F1 per run, missing values as 0."""
    return seg_runs.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
                                    ("boundary_precision", "boundary_recall", "boundary_f1")])


def attach_confusion(confusion: DataFrame, runs_with_metrics: DataFrame, keys=RUN) -> DataFrame:
    """Confusion cells only for runs that already have metrics (left semi-join)."""
    return confusion.join(runs_with_metrics.select(*keys).distinct(), list(keys), "left_semi")


def model_roster(*tables: DataFrame) -> DataFrame:
    """Distinct (model) over every domain's results."""
    out = None
    for t in tables:
        m = t.select("model")
        out = m if out is None else out.union(m)
    return out.distinct().orderBy("model")
