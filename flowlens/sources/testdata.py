"""Adapters: derive workflow-shaped inputs from the given tables (FIXTURES.md section 3).

The given ``events`` table (event_id, ts, user_id, event_type, value, props) becomes a click log
of workflow instances; ``responses`` and ``segment_responses`` stand in for model outputs so the
evaluation can run end to end. Everything is derived by Spark from the tables, so its work grows
with them. The same rules are written independently as DuckDB SQL in ``flowlens.plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.hashing import draw, draw_sql

# Our own process names. The first two share their first 20 characters so that
# truncated similarity blocks merge.
PROCESS_NAMES = [
    "Quarterly budget review and approval",
    "Quarterly budget review and archive",
    "Invoice processing",
    "Employee onboarding",
    "Contract renewal",
    "Expense report submission",
    "Vendor registration",
]
# A process that only single events of the domain "legal" are given, so that an instance holds two names and label spaces
# differ by domain.
EVENT_PROCESS = "Asset disposal"
# Domains by user_id % 3, and the simulated models. Model "m3" only ever answers
# with a known class, so its reports carry the accuracy row.
DOMAINS = ["finance", "hr", "legal"]
MODELS = ["m1", "m2", "m3"]
FOLDED_MODEL = "m3"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names() -> F.Column:
    return F.array(*[F.lit(n) for n in PROCESS_NAMES])


def wf_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interaction events with a raw text ``time_stamp`` (some 'bad', some in another zone) and a file-order ``event_seq``."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    blk = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5).cast("bigint")
    p = (F.col("user_id") + blk) % len(PROCESS_NAMES)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.concat(F.lit("wf-"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("-"),
                 blk.cast("string")).alias("process_instance_uuid"),
        F.when(F.col("event_id") % 101 == 0, F.lit("bad"))
         .when(F.col("event_id") % 103 == 0, F.concat(F.col("ts").cast("string"), F.lit("+02:00")))
         .otherwise(F.col("ts").cast("string")).alias("time_stamp"),
        F.when((F.col("event_id") % 29 == 0) & (F.col("user_id") % 3 == 2), F.lit(EVENT_PROCESS))
         .otherwise(F.element_at(_names(), (p + 1).cast("int"))).alias("process_name"),
        F.concat(F.lit("app_"), (F.col("event_id") % 5).cast("string")).alias("application_name"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("event_type")).alias("description"),
        F.concat(F.lit("screen_"), (k % 12).cast("string")).alias("screen_name"),
        F.col("event_id").alias("event_seq"),
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.col("user_id") % 3 + 1).cast("int")).alias("domain"),
    )


def responses(instances: DataFrame) -> DataFrame:
    """Simulated classification outputs: one text per (instance, model).

    ``instances`` needs workflow_id, domain, process_name. Models are attached with a row-local
    generator (explode of a literal array), not a join.
    """
    v_raw = draw("resp", F.col("model"), F.col("workflow_id"))
    v = F.when(F.col("model") == FOLDED_MODEL, v_raw % 80).otherwise(v_raw % 100)
    p = F.array_position(_names(), F.col("process_name")) - 1
    wrong = F.element_at(_names(), ((p + 1 + F.col("v") % 3) % len(PROCESS_NAMES) + 1).cast("int"))
    true = F.col("process_name")
    text = (F.when(F.col("v") < 55, F.concat(F.lit("Looking at the screens, this is \\answer{ "), true, F.lit(" }")))
            .when(F.col("v") < 80, F.concat(F.lit("\\answer{"), wrong, F.lit("}")))
            .when(F.col("v") < 86, F.lit("\\answer{Something else}"))
            .when(F.col("v") < 90, F.lit("I am not sure."))
            .when(F.col("v") < 93, F.lit("\\answer{}"))
            .when(F.col("v") < 96, F.concat(F.lit("\\answer{"), true, F.lit("\n}")))
            .otherwise(F.concat(F.lit("First \\answer{"), true, F.lit("}, then \\answer{"), wrong, F.lit("}"))))
    return (instances.select("workflow_id", "domain", "process_name")
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
            .withColumn("v", v)
            .select("domain", "model", "workflow_id", text.alias("generated_text")))


def segment_responses(sequences: DataFrame) -> DataFrame:
    """Simulated segmentation outputs per (sequence, model).

    ``sequences`` needs domain, sequence_id, sample (int), sequence_length and ``true_starts``
    (array of segment starts in slot order, first = 0). Variant v = h('seg', model, domain, i) % 20:
    0 no tag, 1 broken JSON, 2 top-level object, 3 one element without end_index, 4 indices as
    strings, else well-formed. Interior starts shift by h('sh',...) % 9 - 4 and are dropped when
    h('dr',...) % 8 = 0; v % 3 = 0 adds one spurious start h('sp',...) % length at the end.
    """
    s = sequences.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    s = s.withColumn("v", draw("seg", F.col("model"), F.col("domain"), F.col("sample")) % 20)
    shifted = (
        "filter(transform(true_starts, (b, j) -> named_struct("
        f"'s', if(j = 0, 0L, b + {draw_sql("'sh'", 'model', 'domain', 'sample', 'j + 1')} % 9 - 4), "
        f"'keep', j = 0 OR {draw_sql("'dr'", 'model', 'domain', 'sample', 'j + 1')} % 8 <> 0)), "
        "x -> x.keep)"
    )
    s = s.withColumn("_starts", F.expr(f"transform({shifted}, x -> x.s)"))
    s = s.withColumn("_starts", F.when(F.col("v") % 3 == 0, F.concat(
        "_starts", F.array(draw("sp", F.col("model"), F.col("domain"), F.col("sample")) % F.col("sequence_length"))))
        .otherwise(F.col("_starts")))
    # end_index = next start - 1, the last one ends at length - 1
    seg_sql = ("transform(_starts, (x, j) -> named_struct('s', x, 'e', "
               "coalesce(try_element_at(_starts, j + 2), sequence_length) - 1, 'j', j))")
    elem_num = "concat('{\"start_index\": ', cast(x.s as string), ', \"end_index\": ', cast(x.e as string), '}')"
    elem_str = "concat('{\"start_index\": \"', cast(x.s as string), '\", \"end_index\": \"', cast(x.e as string), '\"}')"
    elem_missing = ("if(x.j = least(1, size(_starts) - 1), concat('{\"start_index\": ', cast(x.s as string), '}'), "
                    + elem_num + ")")
    body = lambda elem: F.expr(f"concat('[', array_join(transform({seg_sql}, x -> {elem}), ', '), ']')")
    text = (F.when(F.col("v") == 0, F.lit("I could not find any boundaries."))
            .when(F.col("v") == 1, F.lit("<answer>[{\"start_index\": 0, \"end_index\": </answer>"))
            .when(F.col("v") == 2, F.concat(F.lit("<answer>{\"start_index\": 0, \"end_index\": "),
                                            (F.col("sequence_length") - 1).cast("string"), F.lit("}</answer>")))
            .when(F.col("v") == 3, F.concat(F.lit("<answer>\n"), body(elem_missing), F.lit("\n</answer>")))
            .when(F.col("v") == 4, F.concat(F.lit("<answer>"), body(elem_str), F.lit("</answer>")))
            .otherwise(F.concat(F.lit("Segments follow.\n<answer>\n"), body(elem_num), F.lit("\n</answer>"))))
    return s.select("domain", "model", "sequence_id", text.alias("generated_text"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk embeddings of instances: ``embeddings`` rows grouped by vec_id div 4.

    Columns: instance_id, chunk (vec_id % 4), embedding array<double>, process_name (from label).
    """
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr("vec_id div 4").alias("instance_id"),
        (F.col("vec_id") % 4).alias("chunk"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.element_at(_names(), (F.col("label") % len(PROCESS_NAMES) + 1).cast("int")).alias("process_name"),
    )
