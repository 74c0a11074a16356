"""The driver contract: entry() on sf0.001, every registered query runs, every oracle is a query."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"domain", "model", "label", "precision", "recall", "f1_score", "support"}


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.count() >= 0 and len(df.columns) > 0


def test_a_training_part_that_does_not_import_leaves_the_rest(monkeypatch):
    real = E.importlib.import_module

    def broken(name, *args):
        if name.startswith(("flowlens.llm", "corpus_pipeline")):
            raise ImportError(f"No module named {name!r}")
        return real(name, *args)

    everything = set(E.queries())
    monkeypatch.setattr(E.importlib, "import_module", broken)
    assert set(E.queries()) == {q for q in everything if not q.startswith("op") and q != "pipeline"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_workers_get_the_package_wherever_the_driver_was_started():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {root + "/__spark_entry__.py"!r})
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["embedding_round_trip"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    assert "rows 8000" in out.stdout, out.stderr[-2000:]


def test_oracles_run_in_duckdb():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "events documents embeddings labels conversations pages benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in E.oracle_sql().items():
        rel = con.sql(sql)
        assert len(rel.columns) > 0, name
        rel.fetchall()
