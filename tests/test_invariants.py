"""SURVEY section 5 (d) invariants on the registered queries' own outputs (sf0.001)."""

import os

import pytest
from pyspark.sql import functions as F

from flowlens.functions.arrays import edit_distance
from flowlens.operators import classification as C
from flowlens.operators import similarity as SIM
from flowlens.plans import catalog as K

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_confusion_rows_sum_to_support(spark):
    d = K.detailed(spark, SF)
    cm = C.confusion_matrix(d).groupBy("domain", "model", "actual").agg(F.sum("n").alias("s"))
    rep = C.class_report(d).select("domain", "model", F.col("label").alias("actual"), "support")
    j = cm.join(rep, ["domain", "model", "actual"])
    assert j.count() == rep.count() and j.where(F.col("s") != F.col("support")).count() == 0


def test_edit_distance_symmetric(spark):
    r = K.seg_results(spark, SF)
    sym = r.select(edit_distance("true_boundaries", "pred_boundaries").alias("a"),
                   edit_distance("pred_boundaries", "true_boundaries").alias("b"))
    assert sym.where(F.col("a") != F.col("b")).count() == 0


def test_boundaries_and_distinct_workflows(spark):
    hd = K.SA.sequence_headers(K.slots(spark, SF))
    bad = hd.where((F.size("segment_boundaries") != F.col("num_workflows") + 1)
                   | (F.size(F.array_distinct("workflow_ids")) != F.col("num_workflows")))
    assert bad.count() == 0


def test_process_similarity_symmetric(spark):
    s = {(r.process_i, r.process_j): r.mean_cosine for r in SIM.process_similarity(K.pooled_instances(spark, SF)).collect()}
    assert all(abs(v - s[(j, i)]) < 1e-12 for (i, j), v in s.items())


def test_single_instance_self_similarity(spark):
    df = spark.createDataFrame([(1, "A", [1.0, 2.0]), (2, "B", [0.0, 3.0])], "id int, process_name string, embedding array<double>")
    s = {(r.process_i, r.process_j): r.mean_cosine for r in SIM.process_similarity(df).collect()}
    assert s[("A", "A")] == pytest.approx(1.0) and s[("B", "B")] == pytest.approx(1.0)
