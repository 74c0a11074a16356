"""Queries over what is written and read again: result trees, the run store, the response log, landed events, embeddings.

Each writes what Spark derives from the given tables into the session's shared checkpoint folder, under a new name, and
returns what the shipped readers find there.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import classification as C
from flowlens.operators import instances as I
from flowlens.operators import prompts as PR
from flowlens.operators import reporting as RP
from flowlens.operators import segmentation as SG
from flowlens.operators import similarity as SIM
from flowlens.operators.scoring import embed_chunks, score_resumable
from flowlens.plans import catalog as Q
from flowlens.schemas import DETAILED
from flowlens.session import checkpoint_dir
from flowlens.sources import documents as D
from flowlens.sources import results as R
from flowlens.sources import runs as RUNS
from flowlens.sources import testdata as T
from flowlens.sources.definitions import DEFINITIONS, builtin_definitions, read_definitions
from flowlens.sources.embeddings import read_embedding_csv, vector_text
from flowlens.sources.events import land_events
from flowlens.sources.sinks import write_embeddings

r6 = Q.r6
query = Q.query
RUN = list(RP.RUN)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S5-S7, J8, J9, A20: a tree of result documents
# Which documents the generated tree leaves out, and how its stored numbers differ from recomputed ones, so
# that every choice between stored and recomputed values shows. "m1" reports have an accuracy row (0.5) but no Average;
# "m3" has no detailed results in "hr"; "m2" has neither report nor detailed results in "legal", only a confusion matrix.
NO_AVERAGE, NO_DETAILED, CONFUSION_ONLY = "m1", ("hr", "m3"), ("legal", "m2")
# "m3" documents hold aggregates: F1 is 0.25 more than the mean of the sequences, the edit distance is null.
STORED_MODEL, STORED_SHIFT = "m3", 0.25


def is_run(domain: str, model: str) -> F.Column:
    return (F.col("domain") == domain) & (F.col("model") == model)


def tree_detailed(spark, sf) -> DataFrame:
    return Q.cls_runs(spark, sf).where(~is_run(*NO_DETAILED) & ~is_run(*CONFUSION_ONLY))


def tree_reports(spark, sf) -> DataFrame:
    rows = Q.report_rows(spark, sf).where(~is_run(*CONFUSION_ONLY)).where(~((F.col("model") == NO_AVERAGE) & F.col("label").isin("Average", "accuracy")))
    runs = rows.where(F.col("model") == NO_AVERAGE).select(*RUN).distinct()
    half = [F.lit(0.5).alias(c) for c in ("precision", "recall", "f1_score", "support")]
    return rows.unionByName(runs.select(*RUN, F.lit("accuracy").alias("label"), *half))


def tree_segmentation(spark, sf) -> tuple[DataFrame, DataFrame]:
    results = Q.seg_individual(spark, sf)
    means = SG.aggregate(results, RP.RUN).where(F.col("model") == STORED_MODEL)
    return results, means.withColumn("boundary_f1", F.col("boundary_f1") + STORED_SHIFT).withColumn("edit_distance", F.lit(None).cast("double"))


def result_tree(spark, sf, *files: str) -> str:
    """A tree with the named documents of every run; the folder it lies in."""
    root = scratch(spark, "tree")
    makers = {
        "detailed_results.json": lambda: D.detailed_document(tree_detailed(spark, sf)),
        "report.json": lambda: D.report_document(tree_reports(spark, sf)),
        "confusion_matrix.json": lambda: D.confusion_document(C.confusion_grid(C.pair_counts(Q.cls_runs(spark, sf), RP.RUN), RP.RUN)),
        "segmentation_results.json": lambda: D.segmentation_document(*tree_segmentation(spark, sf))}
    for file in files:
        D.write_documents(makers[file](), root)
    return root


@query
def scan_results(spark, sf):
    root = result_tree(spark, sf, "detailed_results.json", "report.json", "confusion_matrix.json", "segmentation_results.json")
    return R.scan_results(spark, root, "exported")


@query
def load_detailed_results(spark, sf):
    return R.load_detailed(spark, result_tree(spark, sf, "detailed_results.json"), "exported")


@query
def load_reports(spark, sf):
    rows = R.load_reports(spark, result_tree(spark, sf, "report.json"), "exported")
    return rows.select(*RUN, "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score", "support")])


@query
def load_segmentation_results(spark, sf):
    rows, _ = R.load_segmentation(spark, result_tree(spark, sf, "segmentation_results.json"), "exported")

    def listed(segments: str) -> F.Column:
        return F.array_join(F.transform(segments, lambda s: F.concat_ws("-", s["start_index"].cast("string"), s["end_index"].cast("string"))), ",")

    return rows.select(*RUN, "sequence_id", "num_workflows", "sequence_length",
                       *[r6(c).alias(c) for c in ("boundary_precision", "boundary_recall", "boundary_f1")], "edit_distance",
                       listed("true_segments").alias("true_segments"), listed("pred_segments").alias("pred_segments"))


@query
def load_results(spark, sf):
    """What the loaders tell of every classification run: metrics, and accuracy as reported or as recomputed."""
    root = result_tree(spark, sf, "detailed_results.json", "report.json")
    board = RP.classification_leaderboard(R.load_reports(spark, root, "exported"), R.load_detailed(spark, root, "exported"))
    return board.select(*RUN, *[r6(c).alias(c) for c in ("precision", "recall", "f1", "support", "accuracy")], "accuracy_source")


@query
def load_segmentation_runs(spark, sf):
    """Every segmentation run from its document: the stored aggregates where there are any, else recomputed."""
    rows, stored = R.load_segmentation(spark, result_tree(spark, sf, "segmentation_results.json"), "exported")
    runs = RP.segmentation_fallback(stored, rows)
    return runs.select(*RUN, *[r6(c).alias(c) for c in RP.SEGMENTATION_METRICS], "metrics_source")


@query
def attach_confusion(spark, sf):
    root = result_tree(spark, sf, "detailed_results.json", "report.json", "confusion_matrix.json")
    board = RP.classification_leaderboard(R.load_reports(spark, root, "exported"), R.load_detailed(spark, root, "exported"))
    return RP.attach_confusion(R.load_confusion(spark, root, "exported"), board)


# ---------------------------------------------------------------- S8-S11, S13: the run store
def run_store(spark, sf) -> str:
    """A store with two models, "m1" and "org/m2". "m1" is written a second time with the answers of "m3" in the domain
    "hr" only, and then a third time without a commit, as a job leaves it that is killed before its end."""
    root = scratch(spark, "runs")
    detailed = Q.cls_runs(spark, sf)

    def write(rows: DataFrame, commit: bool = True) -> None:
        grid = C.confusion_grid(C.pair_counts(rows, RP.RUN), RP.RUN)
        attempt = RUNS.stage_runs(root, {"detailed_results": rows, "confusion_matrix": grid}, [D.detailed_document(rows), D.confusion_document(grid)])
        if commit:
            RUNS.commit_runs(root, rows.select(*RUN).distinct(), attempt)

    def of(model: str, name: str) -> DataFrame:
        return detailed.where(F.col("model") == model).withColumn("model", F.lit(name))

    write(of("m1", "m1").unionByName(of("m2", "org/m2")))
    write(of("m3", "m1").where("domain = 'hr'"))
    write(of("m3", "m1"), commit=False)
    return root


@query
def stored_run_tables(spark, sf):
    return RUNS.read_table(spark, run_store(spark, sf), "detailed_results", DETAILED)


@query
def stored_run_documents(spark, sf):
    """The same runs from their JSON documents: tables and documents switch together."""
    return R.detailed_rows(RUNS.read_documents(spark, run_store(spark, sf), "detailed_results.json"))


@query
def stored_run_versions(spark, sf):
    return RUNS.current_runs(spark, run_store(spark, sf)).select(*RUN, "version")


# ---------------------------------------------------------------- S2: definitions from a file
@query
def definitions_from_file(spark, sf):
    """The definitions part of the prompts, from a JSON array file in file order."""
    path = scratch(spark, "definitions")
    definitions = builtin_definitions(spark)
    record = F.to_json(F.struct("name", "description"))
    # one small file: an array that is opened before its first record and closed after its last
    last = len(DEFINITIONS) - 1
    line = F.concat(F.when(F.col("def_pos") == 0, "[").otherwise(""), record, F.when(F.col("def_pos") == last, "]").otherwise(","))
    definitions.select("def_pos", line.alias("line")).coalesce(1).sortWithinPartitions("def_pos").select("line").write.text(path)
    return PR.definitions_prompt_text(read_definitions(spark, path), T.wf_events(spark, sf))


# ---------------------------------------------------------------- S12, X1, X2: scoring that is stopped and goes on
def digest_answers(prompts: pd.Series) -> pd.Series:
    """A model that always says the same: the MD5 of its prompt."""
    return prompts.map(lambda p: "\\answer{" + hashlib.md5(p.encode()).hexdigest() + "}")


@query
def resumed_answers(spark, sf):
    """Prompts scored through the log by a job that stops half way and is started again: one answer each, logged once."""
    ev = Q.events(spark, sf)
    prompts = PR.classification_prompts(ev, I.label_encoding(ev))
    log, keys, batches = scratch(spark, "log"), ["domain", "workflow_id"], 4
    score_resumable(prompts, digest_answers, keys, log, "classification/m", batches=batches, only=range(batches // 2))
    return score_resumable(prompts, digest_answers, keys, log, "classification/m", batches=batches).drop("prompt")


# ---------------------------------------------------------------- S1: events landed from many files
LANDED_FILES = 12


@query
def landed_events(spark, sf):
    """The interaction log as several JSON files, landed with their order over all files."""
    ev = T.wf_events(spark, sf)
    src = scratch(spark, "json")
    ordered = ev.repartitionByRange(LANDED_FILES, "event_seq").sortWithinPartitions("event_seq")
    ordered.drop("event_seq", "domain").write.json(src)
    user = F.substring("process_instance_uuid", 4, 6).cast("int")
    domain = F.element_at(F.array(*[F.lit(d) for d in T.DOMAINS]), user % len(T.DOMAINS) + 1)
    landed = I.coerce_timestamps(land_events(spark, f"{src}/*.json", scratch(spark, "landed"), "jsonl", domain))
    return landed.select("event_seq", "process_instance_uuid", "description", "domain",
                         F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_stamp"))


# ---------------------------------------------------------------- S3, S4, X3: embeddings out and in again
def parsed_vectors(texts: pd.Series) -> list:
    """An embedder for chunks whose text is a list of numbers: those numbers."""
    return [json.loads(t) for t in texts]


@query
def embedding_round_trip(spark, sf):
    """Chunks through the embedding hook, pooled per instance, written as CSV with list-text vectors and read back."""
    chunks = T.chunk_vectors(spark, sf)
    names = chunks.groupBy("instance_id").agg(F.min_by("process_name", "chunk").alias("process_name"), F.count(F.lit(1)).cast("int").alias("num_tokens"))
    embedded = embed_chunks(chunks.select("instance_id", "chunk", vector_text(F.col("embedding")).alias("chunk_text")), parsed_vectors, ["instance_id", "chunk"])
    text = F.format_string('first line of %d,\n"second" line', "instance_id")
    table = SIM.pool_embeddings(embedded, ["instance_id"]).join(names, "instance_id").select(
        F.col("instance_id").cast("string").alias("process_instance_uuid"), "process_name", text.alias("process_instance_text"), "num_tokens", "embedding")
    path = scratch(spark, "embeddings")
    write_embeddings(table, path, fmt="csv")
    back = read_embedding_csv(spark, path)
    return back.select(F.col("process_instance_uuid").cast("bigint").alias("instance_id"), "process_name", "process_instance_text", "num_tokens",
                       F.posexplode("embedding").alias("dim", "value")).withColumn("value", r6("value"))


# ---------------------------------------------------------------- J7, A8, A9: the zero-filled grid
@query
def confusion_grid(spark, sf):
    return C.confusion_grid(C.confusion_matrix(Q.detailed(spark, sf)))


@query
def confusion_percent_predicted(spark, sf):
    grid = C.confusion_grid(C.confusion_matrix(Q.detailed(spark, sf)))
    return C.confusion_percent(grid, normalize="predicted").select("domain", "model", "actual", "predicted", r6("percent").alias("percent"))
