"""Instance assembly: click events -> ordered, described workflow instances.

Event order inside an instance is (timestamp, nulls last; then file order ``event_seq``), a total
order. Instances are kept in long form (one row per event with its position) plus a header row;
arrays of events are only built where a prompt needs the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.text import event_description, event_text_strict
from flowlens.operators.indexing import with_group_index

UUID = "process_instance_uuid"
ZONED = r"\d:\d\d.*([Zz]|[+-]\d{1,2}:?\d{2})\s*$"


def coerce_timestamps(events: DataFrame, col: str = "time_stamp") -> DataFrame:
    """Text timestamps -> timestamp_ntz; unparseable values become null. A time with a zone offset becomes
    its UTC time, one without stays as written; the session's zone plays no part."""
    seconds = F.unix_micros(F.col(col).try_cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000)
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return events.withColumn(col, F.coalesce(F.when(F.col(col).rlike(ZONED), utc), F.col(col).try_cast("timestamp_ntz")))


def order_key(ts: str = "time_stamp", seq: str = "event_seq") -> list:
    """Total order of events inside an instance: nulls last, ties in file order."""
    return [F.col(ts).isNull(), F.col(ts), F.col(seq)]


def event_positions(events: DataFrame, id_col: str = UUID, pos_col: str = "pos", group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """0-based position of each event inside its instance, an id of one domain (skew-safe, see operators.indexing)."""
    ev = events.where(F.col(id_col).isNotNull())
    return with_group_index(ev, [*group_cols, id_col], ["time_stamp", "event_seq"], pos_col)


def with_descriptions(events: DataFrame, col: str = "event_text") -> DataFrame:
    return events.withColumn(col, event_description())


def workflow_instances(events: DataFrame, group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """One header row per instance: workflow_id, process_name of its first event, n_events.

    Null instance ids are dropped (they vanish from a pandas groupby too). Aggregates are
    partial (map-side) so a huge instance never lands whole in one task.
    """
    first = F.min_by(F.col("process_name"),
                     F.struct(F.col("time_stamp").isNull(), F.col("time_stamp"), F.col("event_seq")))
    return (events.where(F.col(UUID).isNotNull())
            .groupBy(*group_cols, F.col(UUID).alias("workflow_id"))
            .agg(first.alias("process_name"), F.count(F.lit(1)).alias("n_events")))


def label_encoding(events: DataFrame, group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Sorted distinct process names of all events -> 0-based ids, per label space (one per domain).

    The window runs over the distinct-name table, which holds one row per class.
    """
    names = events.where(F.col("process_name").isNotNull()).select(*group_cols, "process_name").distinct()
    w = Window.partitionBy(*group_cols).orderBy("process_name") if group_cols else Window.orderBy("process_name")
    return names.withColumn("label_id", (F.row_number().over(w) - 1).cast("int"))


def encoded_instances(instances: DataFrame, labels: DataFrame,
                      group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    return instances.join(labels, [*group_cols, "process_name"], "left")


def instance_texts(events: DataFrame, group_cols: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Per instance: the strict event sentences joined by newlines in file order; lines with a
    null part are skipped and counted; the process name is the one of the first row in file order."""
    ev = events.where(F.col(UUID).isNotNull()).withColumn("_t", event_text_strict())
    return (ev.groupBy(*group_cols, F.col(UUID).alias("workflow_id"))
            .agg(F.min_by("process_name", "event_seq").alias("process_name"),
                 F.expr("listagg(_t, '\\n') WITHIN GROUP (ORDER BY event_seq)").alias("instance_text"),
                 F.count_if(F.col("_t").isNull()).alias("n_null_lines")))


def dataset_summary(events: DataFrame, group_cols: tuple[str, ...] = ("domain",),
                    approximate: bool = False) -> DataFrame:
    """Distinct instances and distinct processes per domain (exact, or HyperLogLog++ when asked)."""
    cd = (lambda c: F.approx_count_distinct(c)) if approximate else (lambda c: F.count_distinct(c))
    return (events.groupBy(*group_cols)
            .agg(cd(F.col(UUID)).alias("n_instances"), cd(F.col("process_name")).alias("n_processes"),
                 F.count(F.lit(1)).alias("n_events")))


def ordered_texts(df: DataFrame, id_cols: list[str], order_col: str, text: F.Column, sep: str = "\n",
                  out_col: str = "instance_text") -> DataFrame:
    """Generic instance text: the per-row texts of each instance joined by ``sep`` in the order of
    ``order_col`` (the ordering is applied inside the aggregate), with the number of parts."""
    return (df.withColumn("_t", text).groupBy(*id_cols)
            .agg(F.expr(f"listagg(_t, {sep!r}) WITHIN GROUP (ORDER BY `{order_col}`)").alias(out_col),
                 F.count(F.lit(1)).alias("n_parts")))
