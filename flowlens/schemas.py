"""Declared schemas of the inputs and outputs (no inference at read time)."""

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("process_instance_uuid", T.StringType()),
    T.StructField("time_stamp", T.StringType()),
    T.StructField("process_name", T.StringType()),
    T.StructField("application_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("screen_name", T.StringType()),
])

DETAILED = "workflow_id string, true_class string, predicted_class string, correct boolean"

CELLS = "actual string, predicted string, n bigint"

METRICS = "boundary_precision double, boundary_recall double, boundary_f1 double, edit_distance double"

SEGMENT = "struct<start_index:bigint, end_index:bigint>"

# Per-sequence results as the jobs store them.
SEGMENTATION_ROWS = (
    "sequence_id string, num_workflows bigint, sequence_length bigint, boundary_precision double, boundary_recall double, "
    "boundary_f1 double, edit_distance int, true_boundaries array<bigint>, pred_boundaries array<bigint>, "
    f"pred_segments array<{SEGMENT}>, true_starts array<bigint>"
)

EMBEDDING_CSV = ("process_instance_uuid string, process_name string, process_instance_text string, "
                 "num_tokens int, embedding string")

RESPONSE_LOG = ("item_id string, prompt string, generated_text string, timestamp string, attempt string, run_id string, "
                "batch int")

# Report rows in long form, one per (run, label).
REPORT_FIELDS = "label string, precision double, recall double, f1_score double, support double"
REPORT_ROWS = f"domain string, task string, model string, {REPORT_FIELDS}"
