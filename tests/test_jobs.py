"""End-to-end jobs with a fake model on hand-made events."""

import json

import pandas as pd
from pyspark.sql import functions as F

from flowlens.jobs import classification_job, segmentation_job
from flowlens.schemas import CELLS
from flowlens.sources.definitions import builtin_definitions
from flowlens.sources.runs import read_documents, read_table

COLS = "process_instance_uuid string, time_stamp string, process_name string, application_name string, " \
       "description string, screen_name string, event_seq long, domain string"


def events(spark):
    rows = []
    seq = 0
    for w in range(12):
        for e in range(3 + w % 4):
            rows.append((f"w{w:02d}", f"2024-01-0{1 + e} 00:00:00", ["Invoice processing", "Contract renewal"][w % 2],
                         "app", f"step{e}", "s", seq, "hr"))
            seq += 1
    return spark.createDataFrame(rows, COLS)


def test_classification_job(spark, tmp):
    def scorer(prompts: pd.Series) -> pd.Series:
        # a "model" that always answers the first class listed in the prompt
        return prompts.str.extract(r"Choose one of: ([^,.]+)")[0].map(lambda c: f"\\answer{{{c}}}")

    out = classification_job(events(spark), "fake-model", out_dir=tmp + "/cls", scorer=scorer)
    rows = {r.label: r for r in out["report"].collect()}
    assert rows["Contract renewal"].recall == 1.0 and rows["Invoice processing"].recall == 0.0
    assert abs(rows["accuracy"].precision - 0.5) < 1e-12
    document = read_documents(spark, tmp + "/cls", "report.json").collect()
    assert len(document) == 1 and json.loads(document[0].value)["accuracy"] == {
        "precision": 0.5, "recall": 0.5, "f1-score": 0.5, "support": 0.5}
    # the grid is filled with zeros
    grid = {(r.predicted, r.actual): r.n for r in read_table(spark, tmp + "/cls", "confusion_matrix", CELLS).collect()}
    assert grid == {("Contract renewal", "Contract renewal"): 6, ("Contract renewal", "Invoice processing"): 6,
                    ("Invoice processing", "Contract renewal"): 0, ("Invoice processing", "Invoice processing"): 0}
    cells = {p: json.loads(read_documents(spark, tmp + "/cls", "confusion_matrix.json").first().value)[p] for p in ("Contract renewal", "Invoice processing")}
    assert cells == {p: {a: grid[p, a] for a in ("Contract renewal", "Invoice processing")} for p in cells}


def test_segmentation_job(spark, tmp):
    def scorer(prompts: pd.Series) -> pd.Series:
        return pd.Series(['<answer>[{"start_index": 0, "end_index": 2}, {"start_index": 3, "end_index": 9}]</answer>']
                         * len(prompts))

    out = segmentation_job(events(spark), "fake-model", builtin_definitions(spark), out_dir=tmp + "/seg",
                           scorer=scorer, num_samples=10)
    res = out["results"].collect()
    assert len(res) == 10 and all(0.0 <= r.boundary_precision <= 1.0 for r in res)
    assert out["aggregate"].count() == 1
    document = json.loads(read_documents(spark, tmp + "/seg", "segmentation_results.json").first().value)
    assert [r["sequence_id"] for r in document["individual_results"]] == sorted(r.sequence_id for r in res)
    assert document["individual_results"][0]["pred_segments"] and set(document["aggregate_metrics"]) == {
        "boundary_precision", "boundary_recall", "boundary_f1", "edit_distance"}
    assert out["by_length_bin"].where(F.col("mean_f1").isNull()).count() == 0


def test_report_job_reads_job_outputs(spark, tmp):
    from flowlens.jobs import report_job

    def scorer(prompts: pd.Series) -> pd.Series:
        return prompts.str.extract(r"Choose one of: ([^,.]+)")[0].map(lambda c: f"\\answer{{{c}}}")

    def seg_scorer(prompts: pd.Series) -> pd.Series:
        return pd.Series(['<answer>[{"start_index": 0, "end_index": 2}]</answer>'] * len(prompts))

    out = tmp + "/run"
    classification_job(events(spark), "fake-model", out_dir=out, scorer=scorer)
    segmentation_job(events(spark), "fake-model", builtin_definitions(spark), out_dir=out, scorer=seg_scorer,
                     num_samples=5)
    t = report_job(spark, out, layout="runs")
    lb = t["classification_leaderboard"].collect()
    assert len(lb) == 1 and abs(lb[0].accuracy - 0.5) < 1e-12 and lb[0].accuracy_source == "report"
    assert t["run_accuracy"].collect()[0].total == 12
    seg = t["segmentation_leaderboard"].collect()
    assert len(seg) == 1 and seg[0].model == "fake-model"
    assert t["confusion_matrix"].count() == 4 and t["by_num_workflows"].count() >= 1


def test_segmentation_job_empty_sequences(spark, tmp):
    def scorer(prompts: pd.Series) -> pd.Series:
        return pd.Series(["<answer>[]</answer>"] * len(prompts))

    out = segmentation_job(events(spark), "fake-model", builtin_definitions(spark), scorer=scorer,
                           num_samples=30, min_workflows=0, max_workflows=1)
    res = out["results"].collect()
    assert len(res) == 30 and any(r.num_workflows == 0 for r in res)
    assert all(r.boundary_f1 == 0.0 and r.edit_distance == 0 for r in res)


def test_two_models_in_one_tree_and_one_call_per_prompt(spark, tmp):
    from flowlens.jobs import report_job
    from flowlens.sources.response_log import read_response_log

    calls = spark.sparkContext.accumulator(0)

    def scorer(prompts: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        return prompts.str.extract(r"Choose one of: ([^,.]+)")[0].map(lambda c: f"\\answer{{{c}}}")

    out, log = tmp + "/run", tmp + "/log"
    classification_job(events(spark), "m-a", out_dir=out, scorer=scorer, log_path=log)
    classification_job(events(spark), "org/m-b", out_dir=out, scorer=scorer, log_path=log)
    assert calls.value == 24
    assert {r.run_id: r["count"] for r in read_response_log(spark, log).groupBy("run_id").count().collect()} == {
        "classification/m-a": 12, "classification/m-b": 12}
    t = report_job(spark, out, layout="runs")
    assert {r.model for r in t["classification_leaderboard"].collect()} == {"m-a", "m-b"}
    assert {r.model: r.total for r in t["run_accuracy"].collect()} == {"m-a": 12, "m-b": 12}


def test_segmentation_log(spark, tmp):
    from flowlens.sources.response_log import read_response_log

    def scorer(prompts: pd.Series) -> pd.Series:
        return pd.Series(["<answer>[]</answer>"] * len(prompts))

    segmentation_job(events(spark), "org/m", builtin_definitions(spark), scorer=scorer, num_samples=5, log_path=tmp + "/log")
    assert [r.run_id for r in read_response_log(spark, tmp + "/log").collect()] == ["segmentation/m"] * 5


def test_unreadable_definitions(spark, tmp):
    from pathlib import Path

    from flowlens.sources.definitions import read_definitions
    Path(tmp, "bad.json").write_text('[{"name": "a", "descr')
    Path(tmp, "good.json").write_text('[{"name": "a", "description": "b"}, {"name": "c", "description": null}]')
    assert read_definitions(spark, tmp + "/bad.json") is None
    assert read_definitions(spark, tmp + "/none.json") is None
    assert [(r.def_pos, r.name) for r in read_definitions(spark, tmp + "/good.json").collect()] == [(0, "a"), (1, "c")]


def test_report_only_runs_and_confusion_tables(spark, tmp):
    from pathlib import Path

    from flowlens.jobs import report_job
    run = Path(tmp, "hr", "classification", "m")
    run.mkdir(parents=True)
    row = {"precision": 0.5, "recall": 0.5, "f1-score": 0.5, "support": 4.0}
    (run / "report.json").write_text(json.dumps({"A": row, "Average": row, "accuracy": row | {"precision": 0.75}}))
    (run / "confusion_matrix.json").write_text(json.dumps({"A": {"A": 3, "B": 1}, "B": {"A": 0, "B": 0}}))
    t = report_job(spark, tmp)
    assert [(r.model, r.accuracy, r.accuracy_source) for r in t["classification_leaderboard"].collect()] == [("m", 0.75, "report")]
    assert {(r.predicted, r.actual): r.n for r in t["confusion_matrix"].collect()} == {
        ("A", "A"): 3, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 0}
    assert t["confusion_percent_predicted"].count() == t["confusion_percent_actual"].count() == 4
