"""The run store: runs switch whole, by one commit record."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowlens.schemas import DETAILED
from flowlens.sources import documents as D
from flowlens.sources import results as R
from flowlens.sources import runs as RUNS

RUN = ["domain", "task", "model"]


def detailed(spark, model, n, answer="A"):
    return spark.createDataFrame([("hr", "classification", model, f"w{i}", "A", answer, answer == "A") for i in range(n)],
                                 f"domain string, task string, model string, {DETAILED}")


def write(root, rows):
    return RUNS.write_runs(root, rows.select(*RUN), {"detailed_results": rows}, [D.detailed_document(rows)])


def seen(spark, root):
    """What both readers see of every run; they must agree."""
    tables = RUNS.read_table(spark, root, "detailed_results", DETAILED)
    documents = R.detailed_rows(RUNS.read_documents(spark, root, "detailed_results.json"))
    found = [{(r.model, r.workflow_id): r.predicted_class for r in df.collect()} for df in (tables, documents)]
    assert found[0] == found[1]
    return found[0]


def test_rewriting_replaces_a_run_and_leaves_the_others(spark, tmp):
    write(tmp, detailed(spark, "org/name", 3).unionByName(detailed(spark, "b", 2)))
    write(tmp, detailed(spark, "name", 1, "B"))                       # the same run: a model goes by its last name
    assert seen(spark, tmp) == {("name", "w0"): "B", ("b", "w0"): "A", ("b", "w1"): "A"}
    assert {r.model: r.version for r in RUNS.current_runs(spark, tmp).collect()} == {"name": 2, "b": 1}


def test_what_a_killed_job_leaves_is_not_read(spark, tmp):
    write(tmp, detailed(spark, "m", 2))
    rows = detailed(spark, "m", 5, "B")
    attempt = RUNS.stage_runs(tmp, {"detailed_results": rows}, [D.detailed_document(rows)])      # killed before its commit
    assert seen(spark, tmp) == {("m", "w0"): "A", ("m", "w1"): "A"}

    @F.udf("string")
    def breaks(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):                       # killed while it writes
        write(tmp, rows.withColumn("predicted_class", breaks("predicted_class")))
    assert seen(spark, tmp) == {("m", "w0"): "A", ("m", "w1"): "A"}
    RUNS.commit_runs(tmp, rows.select(*RUN), attempt)                  # finished after all
    assert len(seen(spark, tmp)) == 5


def test_a_run_without_rows_in_a_table_and_an_empty_store(spark, tmp):
    assert RUNS.read_table(spark, tmp + "/none", "detailed_results", DETAILED) is None
    assert RUNS.read_documents(spark, tmp + "/none", "report.json") is None
    assert RUNS.current_runs(spark, tmp + "/none").count() == 0
    write(tmp, detailed(spark, "m", 2))
    empty = detailed(spark, "m", 0)
    RUNS.write_runs(tmp, detailed(spark, "m", 1).select(*RUN), {"detailed_results": empty})
    assert RUNS.read_table(spark, tmp, "detailed_results", DETAILED).count() == 0      # the new attempt has no rows


def test_readers_prune_to_committed_folders(spark, tmp):
    for n in (1, 2, 3):
        write(tmp, detailed(spark, "m", n))
    plan = RUNS.read_table(spark, tmp, "detailed_results", DETAILED)._jdf.queryExecution().executedPlan().toString()
    assert "attempt" in plan.split("PartitionFilters")[1].split("]")[0]
    assert json.loads(RUNS.read_documents(spark, tmp, "detailed_results.json").first().value)[0]["workflow_id"] == "w0"
    assert os.path.isdir(tmp + "/commits")
