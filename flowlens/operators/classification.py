"""Classification evaluation, for many runs at once.

Every function takes ``keys`` — the run key columns (e.g. domain, model) — so one Spark job
evaluates all runs; no per-run driver loop. Row-level data is reduced early to the
(run, true, predicted) count table, whose size is bounded by runs x classes^2 and does not
grow with the number of instances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.parsing import extract_answer
from flowlens.functions.text import f1, safe_div

FORMAT_ERROR = "Format Error"
OTHER = "Other"


def extract_answers(responses: DataFrame, text_col: str = "generated_text") -> DataFrame:
    return responses.withColumn("answer", extract_answer(text_col))


def normalize_outcomes(answers: DataFrame, labels: DataFrame, label_keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """null answer -> 'Format Error'; an answer outside the label space (case-sensitive) -> 'Other'.

    ``labels`` is the label space (label_keys + process_name). It is joined without a broadcast
    hint: AQE turns it into a broadcast join at run time when it is small, and falls back to a
    shuffle join when it is not.
    """
    space = labels.select(*label_keys, F.col("process_name").alias("answer"), F.lit(True).alias("_known"))
    return (answers.join(space, [*label_keys, "answer"], "left")
            .withColumn("predicted_class",
                        F.when(F.col("answer").isNull(), F.lit(FORMAT_ERROR))
                        .when(F.col("_known").isNull(), F.lit(OTHER))
                        .otherwise(F.col("answer")))
            .drop("_known"))


def detailed_results(outcomes: DataFrame, instances: DataFrame, keys: tuple[str, ...] = ("domain", "model"),
                     instance_keys: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Align predictions with truth by workflow id (the reference zips two ordered lists)."""
    truth = instances.select(*instance_keys, "workflow_id", F.col("process_name").alias("true_class"))
    return (outcomes.join(truth, [*instance_keys, "workflow_id"])
            .select(*keys, "workflow_id", "true_class", "predicted_class",
                    (F.col("true_class") == F.col("predicted_class")).alias("correct")))


def accuracy(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    return detailed.groupBy(*keys).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"),
                                       F.count(F.lit(1)).alias("n"))


def pair_counts(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Sparse confusion counts (run, actual, predicted, n); zero cells are implicit."""
    return (detailed.groupBy(*keys, F.col("true_class").alias("actual"), F.col("predicted_class").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_report(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Per-class precision, recall, F1 and support over the labels seen in the truth;
    zero_division gives 0."""
    return class_report_from_counts(pair_counts(detailed, keys), keys)


def class_counts(pc: DataFrame, keys=("domain", "model")) -> DataFrame:
    """(run, label, support, n_pred, tp) of every label that occurs as truth or as prediction: each cell of the count table
    counts once for its row and once for its column, in one aggregate."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("n_pred"), hit.alias("tp")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("n_pred"), F.lit(0).cast("bigint").alias("tp")))
    return (pc.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.label").alias("label"))
            .agg(F.sum("s.support").alias("support"), F.sum("s.n_pred").alias("n_pred"), F.sum("s.tp").alias("tp")))


def with_scores(counts: DataFrame) -> DataFrame:
    return (counts.withColumn("precision", safe_div("tp", "n_pred")).withColumn("recall", safe_div("tp", "support"))
            .withColumn("f1_score", f1("precision", "recall")))


def class_report_from_counts(pc: DataFrame, keys=("domain", "model")) -> DataFrame:
    """class_report over a (run, actual, predicted, n) count table."""
    rows = with_scores(class_counts(pc, keys)).where("support > 0")
    return rows.select(*keys, "label", "precision", "recall", "f1_score", F.col("support").cast("bigint"))


def report_from_counts(pc: DataFrame, keys=("domain", "model")) -> DataFrame:
    """The whole report of every run, support as a double: the classes, 'Average', and 'accuracy' where it is due.

    Two aggregates over the count table: one row a label, then one row a run, which gives both summary rows.
    """
    labels = with_scores(class_counts(pc, keys))
    due = F.col("support") > 0
    means = [F.avg(F.when(due, F.col(c))).alias(c) for c in ("precision", "recall", "f1_score")]
    runs = labels.groupBy(*keys).agg(*means, F.sum("support").cast("double").alias("support"), safe_div(F.sum("tp"), F.sum("support")).alias("acc"),
                                     F.count_if(~due).alias("foreign"))
    average = F.struct(F.lit("Average").alias("label"), "precision", "recall", "f1_score", "support")
    accuracy_row = F.struct(F.lit("accuracy").alias("label"), *[F.col("acc").alias(c) for c in ("precision", "recall", "f1_score", "support")])
    summary = runs.select(*keys, F.explode(F.when(F.col("foreign") == 0, F.array(average, accuracy_row)).otherwise(F.array(average))).alias("r"))
    classes = labels.where(due).select(*keys, "label", "precision", "recall", "f1_score", F.col("support").cast("double").alias("support"))
    return classes.unionByName(summary.select(*keys, "r.*"))


def macro_average(report: DataFrame, keys=("domain", "model")) -> DataFrame:
    """The 'Average' row: unweighted means of P, R, F1 over true labels; support = total."""
    return report.groupBy(*keys).agg(
        F.lit("Average").alias("label"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
        F.sum("support").cast("bigint").alias("support"))


def report_accuracy_row(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    """The 'accuracy' row, present only when every prediction is one of the true labels (otherwise
    the report carries a micro average, which is dropped). All four fields hold the accuracy.
    Computed from the small (run, actual, predicted) count table, not from the row-level data."""
    return accuracy_row_from_counts(pair_counts(detailed, keys), keys)


def accuracy_row_from_counts(pc: DataFrame, keys=("domain", "model")) -> DataFrame:
    truth = pc.select(*keys, F.col("actual").alias("predicted")).distinct().withColumn("_is_true", F.lit(1))
    flagged = pc.join(truth, [*keys, "predicted"], "left")
    agg = flagged.groupBy(*keys).agg(
        safe_div(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("acc"),
        F.max(F.when(F.col("_is_true").isNull(), 1).otherwise(0)).alias("_foreign"))
    return (agg.where(F.col("_foreign") == 0)
            .select(*keys, F.lit("accuracy").alias("label"), F.col("acc").alias("precision"),
                    F.col("acc").alias("recall"), F.col("acc").alias("f1_score"), F.col("acc").alias("support")))


def confusion_matrix(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Sparse (run, actual, predicted, n) over labels(true) ∪ labels(pred); ``confusion_grid`` fills it."""
    return pair_counts(detailed, keys)


def confusion_grid(counts: DataFrame, keys=("domain", "model")) -> DataFrame:
    """The zero-filled grid (run, actual, predicted, n) over labels(true) ∪ labels(pred): two explodes of each run's
    label array, counts joined on. Its size is classes squared a run, whatever the number of instances."""
    labels = counts.groupBy(*keys).agg(F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("labels"))
    grid = (labels.select(*keys, F.explode("labels").alias("actual"), "labels")
            .select(*keys, "actual", F.explode("labels").alias("predicted")))
    return (grid.join(counts.select(*keys, "actual", "predicted", "n"), [*keys, "actual", "predicted"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


def confusion_percent(counts: DataFrame, keys=("domain", "model"), normalize: str = "actual") -> DataFrame:
    """Cell share (in %) of its row; normalize='predicted' reproduces the reference figure, whose
    rows are the predicted classes (SURVEY Q1). Empty rows give no cells (i.e. 0)."""
    by = "actual" if normalize == "actual" else "predicted"
    w = Window.partitionBy(*keys, by)
    return counts.withColumn("percent", safe_div(F.col("n") * 100.0, F.sum("n").over(w)))


def confusion_accuracy(counts: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Diagonal share of the matrix; 0 when it is empty."""
    return counts.groupBy(*keys).agg(
        safe_div(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)),
                 F.sum("n")).alias("accuracy"))


def label_union(detailed: DataFrame, keys=("domain", "model")) -> DataFrame:
    """labels(true) ∪ labels(pred) per run, from the count table."""
    pc = pair_counts(detailed, keys)
    return pc.select(*keys, F.col("actual").alias("label")).union(pc.select(*keys, F.col("predicted").alias("label"))).distinct()


def evaluate(responses: DataFrame, instances: DataFrame, labels: DataFrame,
             keys=("domain", "model"), label_keys=("domain",)) -> DataFrame:
    """responses (keys, workflow_id, generated_text) -> detailed results."""
    out = normalize_outcomes(extract_answers(responses), labels, label_keys)
    return detailed_results(out, instances, keys, label_keys)
