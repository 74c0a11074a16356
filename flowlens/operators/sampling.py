"""Sampling instances into concatenated sequences with known segment boundaries.

Design for scale:
  * the dense per-domain instance index is numbered in ranges (operators.indexing);
  * each sample draws k distinct indices with Floyd's algorithm inside one ``aggregate`` HOF:
    exactly k draws, no retries, no cap, and never a samples x instances join;
  * draws are md5 hashes of (seed, domain, sample, step), so results do not depend on
    partitioning (they cannot reproduce NumPy's generator; the distribution is the same:
    k uniform in [min, max], then a uniform random ordered subset without replacement);
  * the plan (samples x <= max_workflows rows) is joined to the index and to the events by
    equi-joins; only the sampled instances' events are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.hashing import draw_sql
from flowlens.operators.indexing import with_group_index

DEFAULT_SEED = 2404


def dense_index(instances: DataFrame, group_col: str = "domain", id_col: str = "workflow_id") -> DataFrame:
    """0-based index of each instance in ascending id order within its group."""
    return with_group_index(instances, [group_col], [id_col], "idx")


def sample_plan(indexed: DataFrame, num_samples: int = 100, min_workflows: int = 2, max_workflows: int = 4,
                seed: int = DEFAULT_SEED, group_col: str = "domain") -> DataFrame:
    """(group, sample, sequence_id, k, slot, idx): which instance index fills each slot.

    Zero is honoured for every parameter (the reference silently replaced falsy values).
    """
    if min_workflows > max_workflows:
        raise ValueError("min_workflows > max_workflows")
    g = f"`{group_col}`"
    sizes = indexed.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_instances"))
    plan = sizes.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1)))) \
        if num_samples > 0 else sizes.withColumn("sample", F.lit(None).cast("int")).where(F.lit(False))
    k = F.expr(f"{min_workflows} + {draw_sql(str(seed), g, 'sample', repr('k'))} % {max_workflows - min_workflows + 1}")
    plan = plan.withColumn("k", k.cast("int")).withColumn("m", F.least(F.col("k").cast("bigint"), F.col("n_instances")))
    t = f"{draw_sql(str(seed), g, 'sample', 'j')} % (j + 1)"
    floyd = (f"aggregate(sequence(n_instances - m, n_instances - 1), cast(array() AS array<bigint>), "
             f"(acc, j) -> if(array_contains(acc, {t}), array_append(acc, j), array_append(acc, {t})))")
    order = f"array_sort(transform({floyd}, x -> named_struct('o', {draw_sql(str(seed), g, 'sample', repr('o'), 'x')}, 'idx', x)))"
    # m = 0 (k = 0 drawn when min_workflows = 0) keeps one row with a null slot: an empty sequence.
    plan = plan.withColumn("_sel", F.when(F.col("m") > 0, F.expr(order)))
    return (plan.select(group_col, "sample", "k", F.posexplode_outer("_sel").alias("_p", "_s"))
            .select(group_col, "sample", F.concat(F.lit("sequence_"), F.col("sample").cast("string")).alias("sequence_id"),
                    "k", (F.col("_p") + 1).alias("slot"), F.col("_s.idx").alias("idx")))


def sequence_slots(plan: DataFrame, indexed: DataFrame, group_col: str = "domain") -> DataFrame:
    """Attach the sampled instance to each slot and lay out segment offsets (running sum of
    lengths over the slots of a sequence; a window over <= max_workflows rows)."""
    j = plan.join(indexed.select(group_col, "idx", "workflow_id", "process_name", "n_events"), [group_col, "idx"])
    w = Window.partitionBy(group_col, "sample").orderBy("slot")
    return (j.withColumn("seg_start", F.coalesce(
                F.sum("n_events").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
            .withColumn("seg_end", F.col("seg_start") + F.col("n_events") - 1)
            .withColumn("sequence_length", F.sum("n_events").over(Window.partitionBy(group_col, "sample")).cast("bigint")))


def sequence_headers(slots: DataFrame, group_col: str = "domain", plan: DataFrame | None = None) -> DataFrame:
    """One row per sequence: lengths, boundaries (starts + end), workflow ids and types in slot order.
    Arrays hold <= max_workflows elements. With ``plan``, samples that drew no workflow appear as
    empty sequences (boundaries [0])."""
    s = F.array_sort(F.collect_list(F.struct("slot", "seg_start", "workflow_id", "process_name")))
    h = (slots.groupBy(group_col, "sample", "sequence_id")
         .agg(s.alias("_s"), F.count(F.lit(1)).alias("num_workflows"), F.max("sequence_length").alias("sequence_length")))
    h = h.select(group_col, "sample", "sequence_id", "num_workflows", "sequence_length",
                 F.transform("_s", lambda x: x["seg_start"]).alias("true_starts"),
                 F.concat(F.transform("_s", lambda x: x["seg_start"]), F.array("sequence_length")).alias("segment_boundaries"),
                 F.transform("_s", lambda x: x["workflow_id"]).alias("workflow_ids"),
                 F.transform("_s", lambda x: x["process_name"]).alias("workflow_types"))
    if plan is None:
        return h
    empty = plan.where(F.col("slot").isNull()).select(
        group_col, "sample", "sequence_id", F.lit(0).cast("bigint").alias("num_workflows"),
        F.lit(0).cast("bigint").alias("sequence_length"), F.array().cast("array<bigint>").alias("true_starts"),
        F.array(F.lit(0).cast("bigint")).alias("segment_boundaries"),
        F.array().cast("array<string>").alias("workflow_ids"), F.array().cast("array<string>").alias("workflow_types"))
    return h.unionByName(empty)


def concatenated_events(slots: DataFrame, events: DataFrame, group_col: str = "domain",
                        text_col: str = "event_text") -> DataFrame:
    """Gather the events of every sampled instance into sequence positions:
    seq_pos = segment start + position inside the instance.

    Events are first reduced to the sampled instances (a semi-join against at most
    samples x max_workflows ids) and that subset is materialised once, so the big table is scanned
    a single time; positions are then computed on the subset only, with the skew-safe
    per-instance index. An instance drawn by several sequences is gathered once per draw.
    """
    from flowlens.operators.instances import event_positions, with_descriptions
    from flowlens.session import cut_lineage
    keys = [group_col, "process_instance_uuid"]
    ids = slots.select(group_col, F.col("workflow_id").alias("process_instance_uuid")).distinct()
    sampled = cut_lineage(events.join(ids, keys, "left_semi"))
    ev = with_descriptions(event_positions(sampled, group_cols=(group_col,)), text_col).select(
        group_col, F.col("process_instance_uuid").alias("workflow_id"), "pos", text_col)
    return (slots.select(group_col, "sequence_id", "slot", "workflow_id", "seg_start").join(ev, [group_col, "workflow_id"])
            .select(group_col, "sequence_id", (F.col("seg_start") + F.col("pos")).alias("seq_pos"),
                    "slot", "workflow_id", text_col))


def true_segments(slots: DataFrame, group_col: str = "domain") -> DataFrame:
    """[b_i, b_{i+1} - 1] per slot."""
    return slots.select(group_col, "sequence_id", "slot", F.col("seg_start").alias("start_index"),
                        F.col("seg_end").alias("end_index"))


def true_boundaries(slots: DataFrame, group_col: str = "domain") -> DataFrame:
    """Interior boundaries: every segment start except the first (and the final end)."""
    return slots.where(F.col("slot") > 1).select(group_col, "sequence_id", "slot", F.col("seg_start").alias("boundary"))
