"""Segmentation evaluation: parsed segments -> boundaries -> P/R/F1, edit distance, roll-ups.

Per-sequence arrays are small (a handful of boundaries), so metrics are row-local
higher-order functions; the only shuffles are the small roll-up aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.arrays import boundary_metrics, edit_distance
from flowlens.functions.parsing import parse_segments
from flowlens.functions.text import f1, safe_div

DEFAULT_TOLERANCE = 3


def parsed_segments(responses: DataFrame, text_col: str = "generated_text") -> DataFrame:
    return responses.withColumn("pred_segments", parse_segments(text_col))


def predicted_boundaries(parsed: DataFrame) -> DataFrame:
    """start_index of every predicted segment with start > 0; order and duplicates kept."""
    return parsed.withColumn("pred_boundaries", F.transform(
        F.filter("pred_segments", lambda s: s["start_index"] > 0), lambda s: s["start_index"]))


def evaluate(headers: DataFrame, responses: DataFrame, tolerance: int = DEFAULT_TOLERANCE,
             keys=("domain", "model"), seq_keys=("domain",)) -> DataFrame:
    """Per (run, sequence): boundary precision/recall/F1 (tolerance 0 = exact), edit distance.

    headers: seq_keys + sequence_id, num_workflows, sequence_length, true_starts.
    responses: keys + sequence_id, generated_text.
    """
    p = predicted_boundaries(parsed_segments(responses))
    j = p.join(headers, [*seq_keys, "sequence_id"])
    j = j.withColumn("true_boundaries", F.filter("true_starts", lambda x, i: i > 0))
    m = boundary_metrics("true_boundaries", "pred_boundaries", "sequence_length", tolerance)
    return j.select(*keys, "sequence_id", "num_workflows", "sequence_length",
                    m["precision"].alias("boundary_precision"), m["recall"].alias("boundary_recall"),
                    m["f1"].alias("boundary_f1"),
                    # the program's row is as long as its second list: the true side, a few boundaries
                    edit_distance("pred_boundaries", "true_boundaries").alias("edit_distance"),
                    "true_boundaries", "pred_boundaries", "pred_segments", "true_starts")


def boundary_metrics_long(true_boundaries: DataFrame, pred_boundaries: DataFrame, runs: DataFrame, tolerance: int = DEFAULT_TOLERANCE,
                          keys=("domain", "model"), seq_keys=("domain",)) -> DataFrame:
    """Boundary precision, recall and F1 per (run, sequence) from long tables, for sequences of any number of boundaries.

    true_boundaries: seq_keys + sequence_id, boundary; pred_boundaries: keys + sequence_id, boundary; runs: keys +
    sequence_id, sequence_length, one row for every result wanted. A prediction hits when a true boundary lies within
    the tolerance: a band semi-join, by equality of (sequence, bin). Bins are as wide as the band, so a true boundary is
    in at most two. Tolerance 0 is exact mode: positions outside the sequence and repeated positions do not count.
    """
    seq = [*seq_keys, "sequence_id"]
    per = [*keys, "sequence_id"]
    true, pred = true_boundaries.select(*seq, "boundary"), pred_boundaries.select(*per, "boundary")
    if tolerance == 0:
        lengths = runs.select(*seq, "sequence_length").distinct()
        inside = (F.col("boundary") >= 0) & (F.col("boundary") < F.col("sequence_length"))
        true, pred = (df.join(lengths, seq).where(inside).drop("sequence_length").distinct() for df in (true, pred))
    width = 2 * tolerance + 1
    bins = F.sequence(F.floor((F.col("boundary") - tolerance) / width), F.floor((F.col("boundary") + tolerance) / width))
    near = true.select(*[F.col(c).alias(f"_t_{c}") for c in seq], F.col("boundary").alias("_true"), F.explode(bins).alias("_near"))
    binned = pred.withColumn("_bin", F.floor(F.col("boundary") / width))
    band = [F.col(c) == F.col(f"_t_{c}") for c in seq] + [F.col("_bin") == F.col("_near"), F.abs(F.col("boundary") - F.col("_true")) <= tolerance]
    hits = binned.join(near, band, "left_semi").groupBy(*per).agg(F.count(F.lit(1)).alias("_tp"))
    n_pred = pred.groupBy(*per).agg(F.count(F.lit(1)).alias("_np"))
    n_true = true.groupBy(*seq).agg(F.count(F.lit(1)).alias("_nt"))
    counted = runs.select(*per).join(n_pred, per, "left").join(hits, per, "left").join(n_true, seq, "left")
    p, r = safe_div("_tp", "_np"), safe_div("_tp", "_nt")
    return counted.select(*per, p.alias("boundary_precision"), r.alias("boundary_recall"), f1(p, r).alias("boundary_f1"))


def aggregate(results: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Run-level means of precision, recall, F1 and edit distance."""
    return results.groupBy(*keys).agg(
        F.avg("boundary_precision").alias("boundary_precision"), F.avg("boundary_recall").alias("boundary_recall"),
        F.avg("boundary_f1").alias("boundary_f1"), F.avg("edit_distance").alias("edit_distance"))


def f1_by_num_workflows(results: DataFrame, keys=("domain", "model")) -> DataFrame:
    """Mean F1 per number of concatenated workflows, sorted (a small aggregate)."""
    return (results.groupBy(*keys, "num_workflows").agg(F.avg("boundary_f1").alias("mean_f1"))
            .orderBy(*keys, "num_workflows"))


def f1_by_length_bin(results: DataFrame, keys=("domain", "model"), num_bins: int = 5) -> DataFrame:
    """Mean F1 per sequence-length bin: equal-width bins over [min, max] of the run
    (width 1 when all lengths are equal), labelled '{int(lo)}-{int(hi)}'. Rows are grouped
    by label, so two bins with the same label merge (SURVEY Q8).

    Results are first reduced to one row for each length of a run; the range and the bins come from that small table."""
    lengths = results.groupBy(*keys, "sequence_length").agg(F.sum("boundary_f1").alias("_f1"), F.count("boundary_f1").alias("_n"))
    run = Window.partitionBy(*keys)
    ranged = lengths.withColumn("_lo", F.min("sequence_length").over(run)).withColumn("_hi", F.max("sequence_length").over(run))
    w = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / num_bins).otherwise(F.lit(1.0))
    r = ranged.withColumn("_w", w)
    idx = F.least(F.lit(num_bins - 1), ((F.col("sequence_length") - F.col("_lo")) / F.col("_w")).cast("int"))
    r = r.withColumn("_b", idx)
    lo = (F.col("_lo") + F.col("_b") * F.col("_w")).cast("int")
    hi = (F.col("_lo") + (F.col("_b") + 1) * F.col("_w")).cast("int")
    r = r.withColumn("bin_label", F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))).withColumn("bin_start", lo)
    return (r.groupBy(*keys, "bin_label").agg(F.min("bin_start").alias("bin_start"), F.try_divide(F.sum("_f1"), F.sum("_n")).alias("mean_f1"))
            .orderBy(*keys, "bin_start"))


def segment_widths(results: DataFrame, slots: DataFrame, keys=("domain", "model"), seq_keys=("domain",)) -> DataFrame:
    """Bar data for the segment figure: width = end - start + 1 for true and predicted segments."""
    pred = results.select(*keys, "sequence_id", F.posexplode("pred_segments").alias("idx", "s")).select(
        *keys, "sequence_id", F.lit("pred").alias("kind"), "idx", F.col("s.start_index").alias("start_index"),
        (F.col("s.end_index") - F.col("s.start_index") + 1).alias("width"))
    runs = results.select(*keys, "sequence_id")
    true = runs.join(slots.select(*seq_keys, "sequence_id", "slot", "seg_start", "seg_end"), [*seq_keys, "sequence_id"]).select(
        *keys, "sequence_id", F.lit("true").alias("kind"), (F.col("slot") - 1).alias("idx"),
        F.col("seg_start").alias("start_index"), (F.col("seg_end") - F.col("seg_start") + 1).alias("width"))
    return pred.unionByName(true)
