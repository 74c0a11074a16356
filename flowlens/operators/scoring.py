"""X1-X3: the model-call boundary. Prompts go out and texts come back through a user-supplied
batch function run inside Spark tasks (Arrow batches via mapInPandas), or through a table of
responses joined on the item key. Scorer parallelism = number of partitions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import cut_lineage
from flowlens.sources import response_log as LOG

# Parts that a resumable run logs one by one: a killed run loses at most the part it was at.
LOG_BATCHES = 16


def score_prompts(prompts: DataFrame, scorer: Callable[[pd.Series], pd.Series], id_cols: list[str],
                  prompt_col: str = "prompt", out_col: str = "generated_text", batch_size: int = 8) -> DataFrame:
    """Call ``scorer`` on slices of ``batch_size`` prompts. A scorer that raises fails the job, so an
    outage is never taken for an answer; for a single text it cannot parse it returns None."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*id_cols).schema.fields)
    schema += f", `{out_col}` string"
    bs = max(1, int(batch_size))

    def run(batches):
        for pdf in batches:
            outs = []
            for i in range(0, len(pdf), bs):
                part = pdf[prompt_col].iloc[i:i + bs].reset_index(drop=True)
                got = pd.Series(scorer(part), dtype="object").reset_index(drop=True)
                if len(got) != len(part):
                    raise ValueError("scorer returned a different number of texts")
                outs.append(got)
            res = pdf[id_cols].copy()
            res[out_col] = pd.concat(outs, ignore_index=True) if outs else pd.Series([], dtype="object")
            yield res

    return prompts.select(*dict.fromkeys([*id_cols, prompt_col])).mapInPandas(run, schema)


def score_resumable(prompts: DataFrame, scorer: Callable[[pd.Series], pd.Series], id_cols: list[str], log_path: str, run_id: str,
                    prompt_col: str = "prompt", batch_size: int = 8, batches: int = LOG_BATCHES,
                    only: range | None = None) -> DataFrame:
    """Score prompts through the response log: what the log already answers is not asked again.

    Prompts are dealt to ``batches`` parts by the hash of their key. Each part asks what is still open and appends its
    answers in one commit, so a job that is killed and started again goes on where it stopped; a provider that fails
    stops the job with the finished parts kept. ``only`` limits a call to some parts. Returns id_cols, the prompt and
    its one answer (of the parts done so far); two runs that raced agree on the answer that was logged first.
    """
    item = LOG.item_id(id_cols)
    keyed = cut_lineage(prompts.select(*id_cols, F.col(prompt_col).alias("prompt")).withColumn("item_id", item)
                        .withColumn("batch", LOG.batch_of(F.col("item_id"), batches)))
    for batch in only if only is not None else range(batches):
        open_prompts = LOG.unanswered(keyed.select("item_id", "prompt", "batch"), log_path, run_id, batch)
        scored = score_prompts(open_prompts, scorer, ["item_id", "prompt", "batch"], batch_size=batch_size)
        LOG.append_answers(scored, log_path, run_id)
    found = LOG.answers(keyed.select("item_id", "prompt"), log_path, run_id)
    return keyed.select(*id_cols, "item_id", "prompt").join(found, ["item_id", "prompt"]).select(*id_cols, "prompt", "generated_text", "n_logged")


def join_responses(prompts: DataFrame, responses: DataFrame, id_cols: list[str]) -> DataFrame:
    """Responses supplied as a table: a left join keeps prompts without an answer (null text)."""
    return prompts.join(responses, id_cols, "left")


def embed_chunks(chunks: DataFrame, embedder: Callable[[pd.Series], list], id_cols: list[str],
                 text_col: str = "chunk_text", out_col: str = "embedding") -> DataFrame:
    """X3: embed chunk texts in Arrow batches with a user-supplied function (texts -> vectors)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*id_cols).schema.fields)
    schema += f", `{out_col}` array<double>"

    def run(batches):
        for pdf in batches:
            res = pdf[id_cols].copy()
            res[out_col] = list(embedder(pdf[text_col].reset_index(drop=True)))
            yield res

    return chunks.select(*id_cols, text_col).mapInPandas(run, schema)
