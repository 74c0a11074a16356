"""Prompt rendering: classification prompts per instance, segmentation prompts per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Our own prompt templates. {classes}/{sequence}/{definitions} are the slots.
CLASSIFICATION_TEMPLATE = (
    "Which workflow does this interaction log belong to? Choose one of: {classes}.\n\n"
    "Interaction log:\n{sequence}\n\n"
    "Give the workflow name inside \\answer{{}}."
)
SEGMENTATION_TEMPLATE = (
    "The interaction log below concatenates several workflows. Known workflows:\n{definitions}\n"
    "Interaction log (numbered from 0):\n{sequence}\n\n"
    "Return a JSON list of {{\"start_index\": i, \"end_index\": j}} segments (inclusive, contiguous, "
    "covering the log) inside <answer></answer>."
)
NO_DEFINITIONS = "No process definitions available."


def _render(template: str, **slots) -> F.Column:
    """Render a str.format-style template with Column slots, as one concat()."""
    import string
    parts = []
    for lit, field, _, _ in string.Formatter().parse(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(slots[field])
    return F.concat(*parts)


def class_lists(labels: DataFrame, group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """', '-joined sorted class names per label space (one short row per domain)."""
    return labels.groupBy(*group_cols).agg(
        F.array_join(F.array_sort(F.collect_list("process_name")), ", ").alias("classes"))


def classification_prompts(events: DataFrame, labels: DataFrame,
                           group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """One prompt per instance: classes joined by ', ', event sentences joined by '\\n' in event
    order (timestamp, nulls last, then file order). The order is applied inside the aggregate, so
    no per-event position (and no extra shuffle) is needed."""
    seq = (events.where(F.col("process_instance_uuid").isNotNull())
           .groupBy(*group_cols, F.col("process_instance_uuid").alias("workflow_id"))
           .agg(F.expr("listagg(concat(coalesce(description, 'None'), ' in the screen ', "
                       "coalesce(screen_name, 'None'), ' of the application ', coalesce(application_name, 'None')), "
                       "'\\n') WITHIN GROUP (ORDER BY time_stamp ASC NULLS LAST, event_seq)").alias("sequence")))
    return (seq.join(class_lists(labels, group_cols), list(group_cols))
            .select(*group_cols, "workflow_id",
                    _render(CLASSIFICATION_TEMPLATE, classes=F.col("classes"), sequence=F.col("sequence")).alias("prompt")))


def definitions_prompt_text(definitions: DataFrame, observed: DataFrame,
                            group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """'- {name}: {description}\\n' for every definition whose name matches an observed process
    name case-insensitively, in definition-file order, with the definition's spelling.

    definitions: (def_pos, name, description); observed: group_cols + process_name.
    """
    obs = observed.select(*group_cols, F.lower("process_name").alias("_lname")).distinct()
    defs = definitions.withColumn("_lname", F.lower("name"))
    kept = defs.join(obs, "_lname", "inner")  # semi-join per domain (obs is distinct per domain)
    text = (kept.groupBy(*group_cols)
            .agg(F.expr("listagg(concat('- ', name, ': ', description, '\\n'), '') "
                        "WITHIN GROUP (ORDER BY def_pos)").alias("definitions_text")))
    domains = observed.select(*group_cols).distinct()
    return (domains.join(text, list(group_cols), "left")
            .select(*group_cols, F.coalesce("definitions_text", F.lit("")).alias("definitions_text")))


def undefined_processes(definitions: DataFrame, observed: DataFrame,
                        group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Observed process names with no definition, even case-insensitively (left anti-join)."""
    obs = observed.select(*group_cols, "process_name").distinct().withColumn("_lname", F.lower("process_name"))
    defs = definitions.select(F.lower("name").alias("_lname")).distinct()
    return obs.join(defs, "_lname", "left_anti").drop("_lname")


def segmentation_prompts(sequence_events: DataFrame, definitions_text: DataFrame,
                         group_cols: tuple[str, ...] = ("domain",), sequences: DataFrame | None = None) -> DataFrame:
    """One prompt per sequence: lines '{i}. {event}' numbered from 0, plus the definitions text.
    With ``sequences`` (group_cols + sequence_id), sequences without events get a prompt too."""
    seq = (sequence_events.groupBy(*group_cols, "sequence_id")
           .agg(F.expr("listagg(concat(cast(seq_pos AS string), '. ', event_text), '\\n') "
                       "WITHIN GROUP (ORDER BY seq_pos)").alias("sequence")))
    if sequences is not None:
        seq = (sequences.select(*group_cols, "sequence_id").join(seq, [*group_cols, "sequence_id"], "left")
               .withColumn("sequence", F.coalesce("sequence", F.lit(""))))
    return (seq.join(definitions_text, list(group_cols), "left")
            .select(*group_cols, "sequence_id",
                    _render(SEGMENTATION_TEMPLATE,
                            definitions=F.coalesce("definitions_text", F.lit(NO_DEFINITIONS)),
                            sequence=F.col("sequence")).alias("prompt")))


__all__ = ["CLASSIFICATION_TEMPLATE", "SEGMENTATION_TEMPLATE", "classification_prompts",
           "definitions_prompt_text", "undefined_processes", "segmentation_prompts", "class_lists"]
