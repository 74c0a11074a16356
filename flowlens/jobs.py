"""End-to-end jobs: what the reference's three scripts do, as Spark jobs.

  classification_job  events -> instances -> prompts -> responses -> metrics -> result files
  segmentation_job    events -> sampled sequences -> prompts -> responses -> metrics -> result files
  report_job          result tree -> leaderboards and roll-ups

Responses come either from a user batch function (``scorer``: pandas Series of prompts ->
Series of texts, run inside tasks) or from a response table keyed like the prompts. Results are
written to a run store: Parquet tables and per-run JSON documents that switch together (sources.runs).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators import classification as C
from flowlens.operators import instances as I
from flowlens.operators import prompts as PR
from flowlens.operators import reporting as RP
from flowlens.operators import sampling as SA
from flowlens.operators import segmentation as SG
from flowlens.operators.scoring import join_responses, score_prompts, score_resumable
from flowlens.schemas import CELLS, DETAILED, METRICS, REPORT_FIELDS, REPORT_ROWS, SEGMENTATION_ROWS
from flowlens.session import cut_lineage
from flowlens.sources import documents as D
from flowlens.sources import results as R
from flowlens.sources import runs as RUNS
from flowlens.sources import response_log as LOG

Scorer = Callable[[pd.Series], pd.Series]


def _responses(prompts: DataFrame, id_cols: list[str], scorer: Scorer | None, responses: DataFrame | None,
               batch_size: int, log_path: str | None, run_id: str) -> DataFrame:
    """The answers, fixed before anything reads them, so that the log and the metrics see the same texts.

    With a scorer and a log, prompts that the run's log answers are not asked again. Answers that come as a table are
    logged as they are.
    """
    if scorer is not None and log_path:
        return cut_lineage(score_resumable(prompts, scorer, id_cols, log_path, run_id, batch_size=batch_size).select(*id_cols, "generated_text"))
    if scorer is not None:
        return cut_lineage(score_prompts(prompts, scorer, id_cols, batch_size=batch_size))
    if responses is None:
        raise ValueError("give a scorer or a responses table")
    found = cut_lineage(join_responses(prompts.select(*id_cols), responses, id_cols))
    if log_path:
        LOG.append_response_log(prompts.join(found, id_cols).withColumn("item_id", LOG.item_id(id_cols)), log_path, run_id, item_col="item_id")
    return found


def run_model(model: str) -> str:
    """S13: the one name a run goes by, in tables, documents and logs: the part after the last '/'."""
    return model.rsplit("/", 1)[-1]


def classification_job(events: DataFrame, model: str, out_dir: str | None = None, scorer: Scorer | None = None,
                       responses: DataFrame | None = None, task: str = "classification", batch_size: int = 8,
                       log_path: str | None = None) -> dict[str, DataFrame]:
    """events: the event log (process_instance_uuid, time_stamp, process_name, application_name,
    description, screen_name, event_seq, domain). Returns the result tables; writes them when
    ``out_dir`` is given. Other runs in ``out_dir`` stay."""
    model = run_model(model)
    ev = I.coerce_timestamps(events) if dict(events.dtypes).get("time_stamp") == "string" else events
    inst = cut_lineage(I.workflow_instances(ev))
    labels = I.label_encoding(ev)
    prompts = PR.classification_prompts(ev, labels)
    resp = _responses(prompts, ["domain", "workflow_id"], scorer, responses, batch_size, log_path, f"{task}/{model}").withColumn("model", F.lit(model))
    detailed = C.evaluate(resp, inst, labels).withColumn("task", F.lit(task))
    keys = ("domain", "task", "model")
    pc = cut_lineage(C.pair_counts(detailed, keys))   # classes squared rows a run; all reports derive from it
    rows = C.report_from_counts(pc, keys)
    out = {"detailed_results": detailed, "report": rows, "confusion_matrix": pc}
    if out_dir:
        grid = C.confusion_grid(pc, keys)
        RUNS.write_runs(out_dir, pc.select(*keys).distinct(), {"detailed_results": detailed, "report": rows, "confusion_matrix": grid},
                        [D.detailed_document(detailed), D.report_document(rows), D.confusion_document(grid)])
    return out


def segmentation_job(events: DataFrame, model: str, definitions: DataFrame | None, out_dir: str | None = None,
                     scorer: Scorer | None = None, responses: DataFrame | None = None, num_samples: int = 100,
                     min_workflows: int = 2, max_workflows: int = 4, seed: int = SA.DEFAULT_SEED,
                     tolerance: int = SG.DEFAULT_TOLERANCE, task: str = "segmentation",
                     batch_size: int = 8, log_path: str | None = None) -> dict[str, DataFrame]:
    """Sample sequences, prompt, score and evaluate. ``definitions`` None means the definitions
    could not be read (the prompt then says so). Other runs in ``out_dir`` stay."""
    model = run_model(model)
    ev = I.coerce_timestamps(events) if dict(events.dtypes).get("time_stamp") == "string" else events
    inst = cut_lineage(I.workflow_instances(ev))
    ix = SA.dense_index(inst)
    plan = cut_lineage(SA.sample_plan(ix, num_samples, min_workflows, max_workflows, seed))
    slots = cut_lineage(SA.sequence_slots(plan, ix))
    headers = SA.sequence_headers(slots, plan=plan)
    seq_events = SA.concatenated_events(slots, ev)
    if definitions is not None:
        defs = PR.definitions_prompt_text(definitions, ev)     # names of all events, not only of first ones
    else:
        defs = inst.select("domain").distinct().withColumn("definitions_text", F.lit(None).cast("string"))
    prompts = PR.segmentation_prompts(seq_events, defs, sequences=headers)
    resp = _responses(prompts, ["domain", "sequence_id"], scorer, responses, batch_size, log_path, f"{task}/{model}").withColumn("model", F.lit(model))
    results = SG.evaluate(headers, resp, tolerance).withColumn("task", F.lit(task))
    keys = ("domain", "task", "model")
    agg = SG.aggregate(results, keys)
    out = {"results": results, "aggregate": agg, "by_num_workflows": SG.f1_by_num_workflows(results, keys),
           "by_length_bin": SG.f1_by_length_bin(results, keys)}
    if out_dir:
        RUNS.write_runs(out_dir, agg.select(*keys), {"segmentation_results": results, "segmentation_aggregates": agg},
                        [D.segmentation_document(results, agg)])
    return out


def stored_results(spark, root: str, layout: str) -> dict[str, DataFrame | None]:
    """The result tables under ``root``: of a run store ("runs"), read from its Parquet tables alone, or of a tree of JSON
    documents ("tree" as other tools lay it out, "exported" as Spark wrote it)."""
    if layout == "runs":
        cells = RUNS.read_table(spark, root, "confusion_matrix", CELLS)
        return {"detailed": RUNS.read_table(spark, root, "detailed_results", DETAILED),
                "report": RUNS.read_table(spark, root, "report", REPORT_FIELDS), "confusion": cells,
                "individual": RUNS.read_table(spark, root, "segmentation_results", SEGMENTATION_ROWS),
                "aggregates": RUNS.read_table(spark, root, "segmentation_aggregates", METRICS)}
    segmentation = R.load_segmentation(spark, root, layout) or (None, None)
    return {"detailed": R.load_detailed(spark, root, layout), "report": R.load_reports(spark, root, layout),
            "confusion": R.load_confusion(spark, root, layout), "individual": segmentation[0], "aggregates": segmentation[1]}


def report_job(spark, results_root: str, layout: str = "tree") -> dict[str, DataFrame]:
    """Roll-ups over a result tree <root>/<domain>/<task>/<model>/*.json (layout "tree"), the same tree as Spark exports
    it ("exported"), or the run store that the jobs above write to ``out_dir`` ("runs")."""
    out: dict[str, DataFrame] = {}
    found = stored_results(spark, results_root, layout)
    det, rep, cells = found["detailed"], found["report"], found["confusion"]
    if det is not None:
        out["run_accuracy"] = RP.run_accuracy(det)
        out["class_accuracy"] = RP.class_accuracy(det)
        out["domain_accuracy"] = RP.domain_accuracy(det)
    if det is not None or rep is not None:
        # a run with only one of the two files still has its row
        det = spark.createDataFrame([], f"domain string, task string, model string, {DETAILED}") if det is None else det
        rep = spark.createDataFrame([], REPORT_ROWS) if rep is None else rep
        out["class_report"] = rep
        out["classification_leaderboard"] = board = RP.classification_leaderboard(rep, det)
        if cells is not None:
            cells = out["confusion_matrix"] = RP.attach_confusion(cells, board)
            for by in ("actual", "predicted"):
                out[f"confusion_percent_{by}"] = C.confusion_percent(cells, RP.RUN, normalize=by)
    ind = found["individual"]
    if ind is not None:
        runs = RP.segmentation_fallback(found["aggregates"], ind)
        out["segmentation_leaderboard"] = RP.segmentation_leaderboard(runs)
        out["domain_segmentation_f1"] = RP.domain_segmentation_f1(runs)
        out["by_num_workflows"] = SG.f1_by_num_workflows(ind, RP.RUN)
        out["by_length_bin"] = SG.f1_by_length_bin(ind, RP.RUN)
    return out
