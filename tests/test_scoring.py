"""The model-call hook (mapInPandas) and the response log that a stopped run goes on from."""

import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

from flowlens.operators.scoring import embed_chunks, score_prompts, score_resumable
from flowlens.sources.response_log import answers, append_answers, batch_of, read_response_log


def test_score_prompts(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "workflow_id int, prompt string")

    def scorer(s: pd.Series) -> pd.Series:
        return s.str.upper().map(lambda x: None if x == "P13" else f"\\answer{{{x}}}")

    got = {r.workflow_id: r.generated_text for r in score_prompts(prompts, scorer, ["workflow_id"], batch_size=4).collect()}
    assert got == {k: None if k == 13 else f"\\answer{{P{k}}}" for k in range(20)}


def test_a_failing_provider_fails_the_job(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "workflow_id int, prompt string")

    def scorer(s: pd.Series) -> pd.Series:
        raise RuntimeError("provider error")

    with pytest.raises(Exception, match="provider error"):
        score_prompts(prompts, scorer, ["workflow_id"]).collect()


def test_embed_chunks(spark):
    ch = spark.createDataFrame([(1, 0, "a b"), (1, 1, "c")], "id int, chunk int, chunk_text string")
    out = embed_chunks(ch, lambda s: [[float(len(t)), 1.0] for t in s], ["id", "chunk"]).collect()
    assert sorted((r.chunk, r.embedding) for r in out) == [(0, [3.0, 1.0]), (1, [1.0, 1.0])]


def batch_calls(calls):
    def scorer(s: pd.Series) -> pd.Series:
        calls.add(len(s))
        return s.map(lambda x: f"\\answer{{{x}}}")
    return scorer


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp):
    prompts = spark.createDataFrame([(f"w{i}", f"p{i}") for i in range(60)], "workflow_id string, prompt string")
    calls = spark.sparkContext.accumulator(0)
    batch = {r.workflow_id: r.b for r in prompts.select("workflow_id", batch_of(F.col("workflow_id"), 6).alias("b")).collect()}
    late = {w for w, b in batch.items() if b >= 3}

    def fails_late(s: pd.Series) -> pd.Series:
        if any("w" + p[1:] in late for p in s):
            raise RuntimeError("killed")
        calls.add(len(s))
        return s.map(lambda x: f"\\answer{{{x}}}")

    log = os.path.join(tmp, "log")
    with pytest.raises(Exception, match="killed"):
        score_resumable(prompts, fails_late, ["workflow_id"], log, "run", batches=6)
    done = calls.value
    assert done == 60 - len(late) == read_response_log(spark, log).count()
    got = score_resumable(prompts, batch_calls(calls), ["workflow_id"], log, "run", batches=6).collect()
    assert calls.value == 60                                            # nothing was asked twice
    assert {r.workflow_id: r.generated_text for r in got} == {f"w{i}": f"\\answer{{p{i}}}" for i in range(60)}
    assert {r.n_logged for r in got} == {1}
    # a third call asks nothing; a changed prompt and another run are asked
    score_resumable(prompts, batch_calls(calls), ["workflow_id"], log, "run", batches=6)
    assert calls.value == 60
    changed = prompts.withColumn("prompt", F.when(F.col("workflow_id") == "w7", "new").otherwise(F.col("prompt")))
    again = {r.workflow_id: r.generated_text for r in score_resumable(changed, batch_calls(calls), ["workflow_id"], log, "run", batches=6).collect()}
    assert calls.value == 61 and again["w7"] == "\\answer{new}" and len(again) == 60


def test_racing_runs_agree_on_the_first_answer(spark, tmp):
    prompts = spark.createDataFrame([("a", "p", 0)], "item_id string, prompt string, batch int")
    log = os.path.join(tmp, "log")
    for text in ("first", "second"):
        append_answers(prompts.withColumn("generated_text", F.lit(text)), log, "run")
    got = answers(prompts, log, "run").collect()
    assert [(r.generated_text, r.n_logged) for r in got] == [("first", 2)]


def test_null_answers_and_composite_keys(spark, tmp):
    prompts = spark.createDataFrame([("d", "a", "p"), (None, "a", "q")], "domain string, workflow_id string, prompt string")
    got = score_resumable(prompts, lambda s: s.map(lambda x: None if x == "p" else x), ["domain", "workflow_id"], os.path.join(tmp, "log"), "run", batches=2).collect()
    assert {(r.domain, r.workflow_id): r.generated_text for r in got} == {("d", "a"): None, (None, "a"): "q"}
    assert read_response_log(spark, os.path.join(tmp, "missing")).count() == 0
