"""Roll-ups, display names, and a round trip through the sinks and the result-tree readers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions.text import display_name
from flowlens.operators import classification as C
from flowlens.operators import reporting as RP
from flowlens.sources import documents as D
from flowlens.sources import results as R


def test_display_names(spark):
    names = ["gpt-4.1", "hr", "finance", "hr_classification", "finance_task_two", "some_model_x", "qWEN", "m1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r.n: r.d for r in df.select("n", display_name("n", ["finance", "hr", "legal"]).alias("d")).collect()}
    assert got == {"gpt-4.1": "GPT-4.1", "hr": "HR", "finance": "Finance", "hr_classification": "HR - Classification",
                   "finance_task_two": "Finance - Task Two", "some_model_x": "Some Model X", "qWEN": "Qwen", "m1": "M1"}


def _detailed(spark):
    rows = [("hr", "classification", "m1", "w1", "A", "A", True), ("hr", "classification", "m1", "w2", "A", "B", False),
            ("hr", "classification", "m1", "w3", "B", "B", True), ("hr", "classification", "m2", "w1", "A", "Other", False),
            ("hr", "classification", "m2", "w2", None, "A", None)]
    return spark.createDataFrame(rows, "domain string, task string, model string, workflow_id string, "
                                       "true_class string, predicted_class string, correct boolean")


def test_rollups(spark):
    d = _detailed(spark)
    ra = {r.model: (r.correct, r.incorrect, r.total) for r in RP.run_accuracy(d).collect()}
    assert ra == {"m1": (2, 1, 3), "m2": (0, 2, 2)}
    ca = {(r.model, r.true_class): r.rank for r in RP.class_accuracy(d).collect()}
    assert ca[("m2", "Unknown")] in (1, 2) and ca[("m1", "A")] == 1
    keys = ("domain", "task", "model")
    rep = C.class_report(d.where(F.col("true_class").isNotNull()), keys)
    rows = rep.unionByName(C.macro_average(rep, keys))
    fb = {r.model: (r.accuracy, r.accuracy_source) for r in RP.accuracy_fallback(rows, d).collect()}
    assert fb["m1"] == (2 / 3, "detailed")


def test_result_tree_round_trip(spark, tmp):
    # a small tree in the reference layout
    base = os.path.join(tmp, "res", "hr", "classification", "m1")
    os.makedirs(base)
    det = [{"workflow_id": "w1", "true_class": "A", "predicted_class": "A", "correct": True},
           {"workflow_id": "w2", "true_class": "A", "predicted_class": "B", "correct": False}]
    json.dump(det, open(os.path.join(base, "detailed_results.json"), "w"), indent=2)     # many lines, one document
    rep = {"A": {"precision": 1.0, "recall": 0.5, "f1-score": 2 / 3, "support": 2.0},
           "B": {"precision": 0.0, "recall": 0.0, "f1-score": 0.0, "support": 0.0},
           "Average": {"precision": 0.5, "recall": 0.25, "f1-score": 1 / 3, "support": 2.0}}
    json.dump(rep, open(os.path.join(base, "report.json"), "w"))
    json.dump({"A": {"A": 1, "B": 0}, "B": {"A": 1, "B": 0}}, open(os.path.join(base, "confusion_matrix.json"), "w"))
    seg = os.path.join(tmp, "res", "hr", "segmentation", "m1")
    os.makedirs(seg)
    json.dump({"individual_results": [{"sequence_id": "sequence_0", "num_workflows": 2, "sequence_length": 9,
                                       "boundary_precision": 1.0, "boundary_recall": 0.5, "boundary_f1": 2 / 3,
                                       "edit_distance": 1, "true_segments": [], "pred_segments": []}]},
              open(os.path.join(seg, "segmentation_results.json"), "w"))
    root = os.path.join(tmp, "res")
    files = {(r.domain, r.task, r.model, r.file) for r in R.scan_results(spark, root).collect()}
    assert ("hr", "classification", "m1", "report.json") in files and len(files) == 4
    d = R.load_detailed(spark, root)
    assert d.count() == 2
    reports = R.load_reports(spark, root)
    lb = RP.classification_leaderboard(reports, d).collect()[0]
    assert lb.f1 == 1 / 3 and lb.accuracy == 0.5 and lb.accuracy_source == "detailed"
    cm = {(r.actual, r.predicted): r.n for r in R.load_confusion(spark, root).collect()}
    assert cm[("A", "B")] == 1 and cm[("B", "A")] == 0     # outer key = predicted
    ind, agg = R.load_segmentation(spark, root)
    assert agg.count() == 0
    fb = RP.segmentation_fallback(agg, ind).collect()[0]
    assert fb.boundary_f1 == 2 / 3
    # the documents, written and read again
    grid = C.confusion_grid(C.pair_counts(d, RP.RUN), RP.RUN)
    for lines in (D.confusion_document(grid), D.report_document(reports), D.detailed_document(d), D.segmentation_document(ind.withColumn("true_starts", F.array(F.lit(0).cast("bigint"))), agg)):
        D.write_documents(lines, os.path.join(tmp, "out"))
    files = {(r.domain, r.task, r.model, r.file) for r in R.scan_results(spark, os.path.join(tmp, "out"), "exported").collect()}
    assert files == {("hr", "classification", "m1", f"{f}.json") for f in ("report", "detailed_results", "confusion_matrix")} | {
        ("hr", "segmentation", "m1", "segmentation_results.json")}
    assert {(r.actual, r.predicted): r.n for r in R.load_confusion(spark, os.path.join(tmp, "out"), "exported").collect()} == cm
    assert sorted(R.load_reports(spark, os.path.join(tmp, "out"), "exported").collect()) == sorted(reports.collect())
    assert sorted(R.load_detailed(spark, os.path.join(tmp, "out"), "exported").collect()) == sorted(d.collect())
    back, stored = R.load_segmentation(spark, os.path.join(tmp, "out"), "exported")
    assert stored.count() == 0 and [r.boundary_f1 for r in back.collect()] == [2 / 3]


def test_long_documents_keep_their_order_and_odd_names(spark, tmp):
    rows = [("h r", "c%1", 'm "x"+y', f"w{i:04d}", 'A "quoted" \\ name', "B", i % 2 == 0) for i in range(500)]
    d = spark.createDataFrame(rows, "domain string, task string, model string, workflow_id string, true_class string, "
                                    "predicted_class string, correct boolean").repartition(6)
    D.write_documents(D.detailed_document(d), tmp + "/out")
    assert sorted(tuple(r) for r in R.load_detailed(spark, tmp + "/out", "exported").collect()) == sorted(rows)
    parts = [os.path.join(p, f) for p, _, fs in os.walk(tmp + "/out") for f in fs if f.startswith("part-")]
    assert len(parts) == 1                                  # one document, one file
    document = json.load(open(parts[0]))
    assert [r["workflow_id"] for r in document] == [f"w{i:04d}" for i in range(500)]
    grid = C.confusion_grid(C.pair_counts(d, RP.RUN), RP.RUN)
    D.write_documents(D.confusion_document(grid), tmp + "/cells")
    assert {(r.actual, r.predicted): r.n for r in R.load_confusion(spark, tmp + "/cells", "exported").collect()} == {
        (rows[0][4], "B"): 500, ("B", "B"): 0, (rows[0][4], rows[0][4]): 0, ("B", rows[0][4]): 0}


def test_a_document_that_is_not_json_fails(spark, tmp):
    base = os.path.join(tmp, "hr", "classification", "m")
    os.makedirs(base)
    open(os.path.join(base, "detailed_results.json"), "w").write('[{"workflow_id": "w1",')
    with pytest.raises(Exception, match="MALFORMED"):
        R.load_detailed(spark, tmp).collect()
    assert R.load_reports(spark, tmp) is None                # no such file: no rows, no error


def test_stored_or_recomputed_is_chosen_per_run(spark):
    run = "domain string, task string, model string, "
    ind = spark.createDataFrame([("d", "segmentation", m, 1.0, 0.5, 0.75, e) for m in ("a", "b") for e in (1, 2)],
                                run + "boundary_precision double, boundary_recall double, boundary_f1 double, edit_distance int")
    stored = spark.createDataFrame([("d", "segmentation", "a", 0.9, None, 0.8, None), ("d", "segmentation", "c", 0.1, 0.2, 0.3, 4.0)],
                                   run + "boundary_precision double, boundary_recall double, boundary_f1 double, edit_distance double")
    got = {r.model: tuple(r)[3:] for r in RP.segmentation_fallback(stored, ind).collect()}
    # a run with stored values takes all of them, nulls too; one without is recomputed; one without results is as stored
    assert got == {"a": (0.9, None, 0.8, None, "stored"), "b": (1.0, 0.5, 0.75, 1.5, "recomputed"), "c": (0.1, 0.2, 0.3, 4.0, "stored")}


def test_report_accuracy_counts_only_beside_an_average(spark):
    fields = "domain string, task string, model string, label string, precision double, recall double, f1_score double, support double"
    rep = spark.createDataFrame([("d", "classification", "a", "accuracy", 0.9, 0.9, 0.9, 0.9), ("d", "classification", "b", "accuracy", 0.9, 0.9, 0.9, 0.9),
                                 ("d", "classification", "b", "Average", 0.1, 0.2, 0.3, 4.0), ("d", "classification", "c", "Average", 0.5, 0.5, 0.5, 2.0)], fields)
    det = spark.createDataFrame([("d", "classification", m, "w", "A", "A", True) for m in ("a", "b", "e")],
                                "domain string, task string, model string, workflow_id string, true_class string, predicted_class string, correct boolean")
    got = {r.model: (r.f1, r.accuracy, r.accuracy_source) for r in RP.classification_leaderboard(rep, det).collect()}
    assert got == {"a": (None, 1.0, "detailed"), "b": (0.3, 0.9, "report"), "c": (0.5, None, None), "e": (None, 1.0, "detailed")}
    assert {r.model for r in RP.accuracy_fallback(rep, det).collect()} == {"a", "b", "e"}


def test_accuracy_rollup_agrees_with_the_single_levels(spark):
    d = _detailed(spark).unionByName(_detailed(spark).withColumn("task", F.lit("segmentation")))
    got = RP.accuracy_rollup(d).collect()
    assert {(r.task, r.model): (r.correct, r.total) for r in got if r.level == "run"} == {
        (r.task, r.model): (r.correct, r.total) for r in RP.run_accuracy(d).collect()}
    assert {(r.task, r.model, r.true_class): (r.correct, r.total) for r in got if r.level == "class"} == {
        (r.task, r.model, r.true_class): (r.correct, r.total) for r in RP.class_accuracy(d).collect()}
    assert {(r.domain, r.model): r.accuracy for r in got if r.level == "domain"} == {
        (r.domain, r.model): r.accuracy for r in RP.domain_accuracy(d).collect()}


def test_report_from_counts(spark):
    d = _detailed(spark).where(F.col("true_class").isNotNull())
    rows = {(r.model, r.label): r for r in C.report_from_counts(C.pair_counts(d, RP.RUN), RP.RUN).collect()}
    # m2 answered a class that is no true class: no accuracy row; m1's holds the accuracy in all four fields
    assert set(rows) == {("m1", "A"), ("m1", "B"), ("m1", "Average"), ("m1", "accuracy"), ("m2", "A"), ("m2", "Average")}
    assert tuple(rows["m1", "accuracy"])[4:] == (2 / 3,) * 4
    assert rows["m1", "Average"].support == 3.0 and rows["m1", "A"].recall == 0.5 and rows["m1", "B"].precision == 0.5


def test_segmentation_json_document(spark):
    from flowlens.operators import segmentation as SG
    headers = spark.createDataFrame([("d", "s0", 2, 10, [0, 4])],
                                    "domain string, sequence_id string, num_workflows int, sequence_length bigint, "
                                    "true_starts array<bigint>")
    resp = spark.createDataFrame([("d", "m", "s0", '<answer>[{"start_index": 0, "end_index": 3}, '
                                                  '{"start_index": 4, "end_index": 9}]</answer>')],
                                 "domain string, model string, sequence_id string, generated_text string")
    res = SG.evaluate(headers, resp)
    keys = ("domain", "task", "model")
    res = res.withColumn("task", F.lit("segmentation"))
    lines = D.segmentation_document(res, SG.aggregate(res, keys)).orderBy("part", "place").collect()
    doc = json.loads("\n".join(r.line for r in lines))
    r = doc["individual_results"][0]
    assert r["true_segments"] == [{"start_index": 0, "end_index": 3}, {"start_index": 4, "end_index": 9}]
    assert r["boundary_f1"] == 1.0 and doc["aggregate_metrics"]["edit_distance"] == 0.0
