"""The registered queries: each reads the given tables (through the adapters) and returns a
DataFrame. Doubles are rounded to 6 places so results compare across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import text as TX
from flowlens.operators import classification as C
from flowlens.operators import instances as I
from flowlens.session import cut_lineage
from flowlens.sources import testdata as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared building blocks
def events(spark, sf) -> DataFrame:
    return I.coerce_timestamps(T.wf_events(spark, sf))


def instances(spark, sf) -> DataFrame:
    """Instance headers, materialised once in the shared checkpoint folder: labels, truth,
    responses and the sampler all read them, and none re-aggregates the events."""
    return cut_lineage(I.workflow_instances(events(spark, sf)))


def labels(spark, sf) -> DataFrame:
    return I.label_encoding(events(spark, sf))


def detailed(spark, sf) -> DataFrame:
    """Per-instance outcomes of every run, materialised once (the run's primary output, written
    as detailed results by the reference); reports and roll-ups read this table."""
    inst = instances(spark, sf)
    return cut_lineage(C.evaluate(T.responses(inst), inst, I.label_encoding(events(spark, sf))))


# ---------------------------------------------------------------- sources / projections
@query
def load_events(spark, sf):
    return T.wf_events(spark, sf).drop("time_stamp")


@query
def coerce_timestamps(spark, sf):
    return events(spark, sf).select(
        "event_seq", "process_instance_uuid",
        F.date_format("time_stamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_stamp"))


@query
def event_descriptions(spark, sf):
    return T.wf_events(spark, sf).select("event_seq", TX.event_description().alias("event_text"))


@query
def event_text_strict(spark, sf):
    return T.wf_events(spark, sf).select("event_seq", TX.event_text_strict().alias("event_text"))


@query
def label_encoding(spark, sf):
    return labels(spark, sf)


# ---------------------------------------------------------------- instance assembly
@query
def workflow_instances(spark, sf):
    inst = instances(spark, sf)
    return I.encoded_instances(inst, I.label_encoding(events(spark, sf)))


@query
def event_positions(spark, sf):
    return I.event_positions(events(spark, sf)).select("domain", "process_instance_uuid", "event_seq", "pos")


@query
def instance_texts(spark, sf):
    return I.instance_texts(T.wf_events(spark, sf))


@query
def dataset_summary(spark, sf):
    return I.dataset_summary(events(spark, sf))


# ---------------------------------------------------------------- classification
@query
def extract_answers(spark, sf):
    inst = instances(spark, sf)
    return C.extract_answers(T.responses(inst)).select("domain", "model", "workflow_id", "answer")


@query
def normalize_outcomes(spark, sf):
    inst = instances(spark, sf)
    out = C.normalize_outcomes(C.extract_answers(T.responses(inst)), I.label_encoding(events(spark, sf)))
    return out.select("domain", "model", "workflow_id", "predicted_class")


@query
def detailed_results(spark, sf):
    return detailed(spark, sf)


@query
def accuracy(spark, sf):
    return C.accuracy(detailed(spark, sf)).select("domain", "model", r6("accuracy").alias("accuracy"), "n")


def _round_report(df):
    return df.select("domain", "model", "label", r6("precision").alias("precision"), r6("recall").alias("recall"),
                     r6("f1_score").alias("f1_score"), r6(F.col("support").cast("double")).alias("support"))


@query
def class_report(spark, sf):
    return _round_report(C.class_report(detailed(spark, sf)))


@query
def macro_average(spark, sf):
    return _round_report(C.macro_average(C.class_report(detailed(spark, sf))))


@query
def report_accuracy_row(spark, sf):
    return _round_report(C.report_accuracy_row(detailed(spark, sf)))


@query
def confusion_matrix(spark, sf):
    return C.confusion_matrix(detailed(spark, sf))


@query
def confusion_percent(spark, sf):
    cm = C.confusion_matrix(detailed(spark, sf))
    return C.confusion_percent(cm).select("domain", "model", "actual", "predicted", r6("percent").alias("percent"))


@query
def confusion_accuracy(spark, sf):
    return C.confusion_accuracy(C.confusion_matrix(detailed(spark, sf))).select(
        "domain", "model", r6("accuracy").alias("accuracy"))


@query
def label_union(spark, sf):
    return C.label_union(detailed(spark, sf))


# ---------------------------------------------------------------- prompts
from flowlens.operators import prompts as PR  # noqa: E402
from flowlens.operators import sampling as SA  # noqa: E402
from flowlens.operators import segmentation as SG  # noqa: E402
from flowlens.sources.definitions import builtin_definitions  # noqa: E402


@query
def classification_prompts(spark, sf):
    ev = events(spark, sf)
    return PR.classification_prompts(ev, I.label_encoding(ev))


@query
def definitions_prompt_text(spark, sf):
    return PR.definitions_prompt_text(builtin_definitions(spark), T.wf_events(spark, sf))


@query
def undefined_processes(spark, sf):
    return PR.undefined_processes(builtin_definitions(spark), T.wf_events(spark, sf))


# ---------------------------------------------------------------- sampling
def indexed(spark, sf, inst: DataFrame | None = None) -> DataFrame:
    return SA.dense_index(instances(spark, sf) if inst is None else inst)


def slots(spark, sf, inst: DataFrame | None = None) -> DataFrame:
    """Sequence slots (samples x <= max_workflows rows), materialised once: headers, responses and
    the event gather all read them."""
    ix = indexed(spark, sf, inst)
    return cut_lineage(SA.sequence_slots(SA.sample_plan(ix), ix))


@query
def dense_index(spark, sf):
    return indexed(spark, sf).select("domain", "workflow_id", "idx")


@query
def sample_plan(spark, sf):
    return SA.sample_plan(indexed(spark, sf))


@query
def segment_boundaries(spark, sf):
    return slots(spark, sf).select("domain", "sequence_id", "slot", "workflow_id", "n_events", "seg_start",
                                   "sequence_length")


@query
def concatenated_sequences(spark, sf):
    return SA.concatenated_events(slots(spark, sf), events(spark, sf))


@query
def true_segments(spark, sf):
    return SA.true_segments(slots(spark, sf))


@query
def true_boundaries(spark, sf):
    return SA.true_boundaries(slots(spark, sf))


@query
def segmentation_prompts(spark, sf):
    inst = instances(spark, sf)
    seq = SA.concatenated_events(slots(spark, sf, inst), events(spark, sf))
    defs = PR.definitions_prompt_text(builtin_definitions(spark), T.wf_events(spark, sf))
    return PR.segmentation_prompts(seq, defs)


# ---------------------------------------------------------------- segmentation
def seg_inputs(spark, sf):
    sl = slots(spark, sf)
    hd = SA.sequence_headers(sl)
    return sl, hd, T.segment_responses(hd)


def seg_results(spark, sf, tolerance=SG.DEFAULT_TOLERANCE) -> DataFrame:
    _, hd, resp = seg_inputs(spark, sf)
    return SG.evaluate(hd, resp, tolerance)


def _list_text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query
def parse_segments(spark, sf):
    _, _, resp = seg_inputs(spark, sf)
    p = SG.parsed_segments(resp)
    return p.select("domain", "model", "sequence_id",
                    _list_text(F.transform("pred_segments", lambda s: s["start_index"])).alias("starts"),
                    _list_text(F.transform("pred_segments", lambda s: s["end_index"])).alias("ends"))


@query
def predicted_boundaries(spark, sf):
    _, _, resp = seg_inputs(spark, sf)
    p = SG.predicted_boundaries(SG.parsed_segments(resp))
    return p.select("domain", "model", "sequence_id", _list_text("pred_boundaries").alias("pred_boundaries"))


def _metrics(df):
    return df.select("domain", "model", "sequence_id", r6("boundary_precision").alias("boundary_precision"),
                     r6("boundary_recall").alias("boundary_recall"), r6("boundary_f1").alias("boundary_f1"))


@query
def boundary_exact(spark, sf):
    return _metrics(seg_results(spark, sf, tolerance=0))


@query
def boundary_tolerant(spark, sf):
    return _metrics(seg_results(spark, sf))


def long_metrics(spark, sf, tolerance: int) -> DataFrame:
    """The boundary metrics from long tables, for which a sequence may have any number of boundaries."""
    sl, hd, resp = seg_inputs(spark, sf)
    pred = SG.predicted_boundaries(SG.parsed_segments(resp)).select("domain", "model", "sequence_id", F.explode("pred_boundaries").alias("boundary"))
    runs = resp.join(hd.select("domain", "sequence_id", "sequence_length"), ["domain", "sequence_id"])
    return _metrics(SG.boundary_metrics_long(SA.true_boundaries(sl), pred, runs, tolerance))


@query
def boundary_exact_long(spark, sf):
    return long_metrics(spark, sf, tolerance=0)


@query
def boundary_tolerant_long(spark, sf):
    return long_metrics(spark, sf, tolerance=SG.DEFAULT_TOLERANCE)


@query
def edit_distance(spark, sf):
    return seg_results(spark, sf).select("domain", "model", "sequence_id", F.col("edit_distance").cast("bigint"))


@query
def segmentation_aggregate(spark, sf):
    a = SG.aggregate(seg_results(spark, sf))
    return a.select("domain", "model", *[r6(c).alias(c) for c in
                    ("boundary_precision", "boundary_recall", "boundary_f1", "edit_distance")])


@query
def f1_by_num_workflows(spark, sf):
    return SG.f1_by_num_workflows(seg_results(spark, sf)).select("domain", "model", "num_workflows",
                                                                 r6("mean_f1").alias("mean_f1"))


@query
def f1_by_length_bin(spark, sf):
    return SG.f1_by_length_bin(seg_results(spark, sf)).select("domain", "model", "bin_label", "bin_start",
                                                              r6("mean_f1").alias("mean_f1"))


@query
def segment_widths(spark, sf):
    sl, hd, resp = seg_inputs(spark, sf)
    return SG.segment_widths(SG.evaluate(hd, resp), sl)


# ---------------------------------------------------------------- similarity
from flowlens.operators import reporting as RP  # noqa: E402
from flowlens.operators import similarity as SIM  # noqa: E402


def documents(spark, sf) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", "text")


def pooled_instances(spark, sf) -> DataFrame:
    """Instance vectors (mean of chunk vectors) with their process, materialised once: the
    embedding table the reference saves, read by every similarity step."""
    cv = T.chunk_vectors(spark, sf)
    names = cv.groupBy("instance_id").agg(F.min_by("process_name", "chunk").alias("process_name"),
                                          F.count(F.lit(1)).alias("n_chunks"))
    pooled = SIM.pool_embeddings(cv, ["instance_id"]).join(names, "instance_id")
    # some instances have no vector, some one that is not a number: they take no part in similarities
    broken = F.transform("embedding", lambda x: F.lit(float("nan")))
    vector = F.when(F.col("instance_id") % 41 == 0, broken).when(F.col("instance_id") % 43 != 0, F.col("embedding"))
    return cut_lineage(pooled.withColumn("embedding", vector))


@query
def token_counts(spark, sf):
    return SIM.token_counts(documents(spark, sf)).select("doc_id", "num_tokens")


@query
def chunk_tokens(spark, sf):
    return SIM.chunk_tokens(documents(spark, sf), ["doc_id"])


@query
def document_chunks(spark, sf):
    """The same cut at a size that many documents exceed."""
    return SIM.chunk_tokens(documents(spark, sf), ["doc_id"], max_tokens=300)


# Small enough that most instances are cut into several chunks.
INSTANCE_CHUNK_TOKENS = 24


@query
def instance_chunks(spark, sf):
    """Chunks of the instance texts, put together from the event sentences without building a whole text."""
    lines = T.wf_events(spark, sf).select("domain", F.col("process_instance_uuid").alias("workflow_id"), "event_seq", TX.event_text_strict().alias("text"))
    return SIM.chunked_lines(lines, ["domain", "workflow_id"], "event_seq", max_tokens=INSTANCE_CHUNK_TOKENS)


@query
def instance_neighbours(spark, sf):
    """The five most similar instances of every instance whose id is divisible by 50, searched among all."""
    near = SIM.nearest_neighbours(pooled_instances(spark, sf), F.col("instance_id") % 50 == 0, k=5)
    return near.select("query", "neighbour", "rank", r6("cosine").alias("cosine"))


@query
def pool_embeddings(spark, sf):
    lg = SIM.pool_long(T.chunk_vectors(spark, sf), ["instance_id"])
    return lg.select("instance_id", "dim", r6("value").alias("value"))


@query
def process_similarity(spark, sf):
    s = SIM.process_similarity(pooled_instances(spark, sf))
    return s.select("process_i", "process_j", r6("mean_cosine").alias("mean_cosine"), "n_i", "n_j")


@query
def similarity_blocks(spark, sf):
    return SIM.similarity_blocks(pooled_instances(spark, sf))


@query
def truncate_labels(spark, sf):
    names = instances(spark, sf).select("process_name").distinct()
    return names.select("process_name", TX.truncate_label("process_name", 20).alias("label_20"),
                        TX.truncate_label("process_name", 25).alias("label_25"))


@query
def parse_embedding_text(spark, sf):
    """Vectors written as list text ('[0.1, 0.2]', as in an embeddings CSV) and parsed back."""
    e = T.table(spark, sf, "embeddings")
    txt = e.select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(
        "embedding", lambda x: x.cast("double").cast("string")), ", "), F.lit("]")).alias("embedding_text"))
    parsed = txt.select("vec_id", F.from_json("embedding_text", "array<double>").alias("v"))
    return parsed.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", "dim", r6("value").alias("value"))


# ---------------------------------------------------------------- reporting
def cls_runs(spark, sf) -> DataFrame:
    return detailed(spark, sf).withColumn("task", F.lit("classification"))


def report_rows(spark, sf, d: DataFrame | None = None) -> DataFrame:
    """Per-class rows, the Average row and the accuracy row, all from one count table, materialised once."""
    pc = cut_lineage(C.pair_counts(detailed(spark, sf) if d is None else d))
    return C.report_from_counts(pc).withColumn("task", F.lit("classification"))


def seg_individual(spark, sf) -> DataFrame:
    return seg_results(spark, sf).withColumn("task", F.lit("segmentation"))


def seg_runs(spark, sf) -> DataFrame:
    return RP.segmentation_fallback(None, seg_individual(spark, sf))


def _r6_all(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query
def run_accuracy(spark, sf):
    return _r6_all(RP.run_accuracy(cls_runs(spark, sf)), {"accuracy"})


@query
def class_accuracy(spark, sf):
    return _r6_all(RP.class_accuracy(cls_runs(spark, sf)), {"accuracy"})


@query
def accuracy_rollup(spark, sf):
    return _r6_all(RP.accuracy_rollup(cls_runs(spark, sf)), {"accuracy"})


@query
def domain_accuracy(spark, sf):
    return _r6_all(RP.domain_accuracy(cls_runs(spark, sf)), {"accuracy"})


@query
def segmentation_fallback(spark, sf):
    """Stored aggregates for one model, deliberately not what its sequences give (F1 shifted, no edit distance), as in the
    generated documents of ``plans.stored``; the other models have none and are recomputed."""
    from flowlens.plans.stored import tree_segmentation
    ind, stored = tree_segmentation(spark, sf)
    return _r6_all(RP.segmentation_fallback(stored, ind), set(RP.SEGMENTATION_METRICS))


@query
def domain_segmentation_f1(spark, sf):
    return _r6_all(RP.domain_segmentation_f1(seg_runs(spark, sf)), {"boundary_f1"})


@query
def accuracy_fallback(spark, sf):
    d = detailed(spark, sf)
    return _r6_all(RP.accuracy_fallback(report_rows(spark, sf, d), d.withColumn("task", F.lit("classification"))),
                   {"accuracy"})


@query
def classification_leaderboard(spark, sf):
    d = detailed(spark, sf)
    lb = RP.classification_leaderboard(report_rows(spark, sf, d), d.withColumn("task", F.lit("classification")))
    return _r6_all(lb.withColumn("support", F.col("support").cast("double")),
                   {"precision", "recall", "f1", "accuracy", "support"})


@query
def segmentation_leaderboard(spark, sf):
    return _r6_all(RP.segmentation_leaderboard(seg_runs(spark, sf)),
                   {"boundary_precision", "boundary_recall", "boundary_f1"})


@query
def model_roster(spark, sf):
    return RP.model_roster(cls_runs(spark, sf), seg_runs(spark, sf))  # classification and segmentation runs


@query
def display_names(spark, sf):
    d = cls_runs(spark, sf)
    names = (d.select(F.col("model").alias("name"))
             .union(d.select(F.col("domain").alias("name")))
             .union(d.select(F.concat("domain", F.lit("_"), "task").alias("name")))
             .union(d.select(F.concat("task", F.lit("_"), "model").alias("name")))
             .union(d.select(F.concat("true_class", F.lit("_x")).alias("name")))
             .distinct())
    return names.select("name", TX.display_name("name", T.DOMAINS).alias("display_name"))


@query
def report_cells(spark, sf):
    d = detailed(spark, sf)
    runs = d.withColumn("task", F.lit("classification"))
    ra = RP.run_accuracy(runs)
    lb = RP.classification_leaderboard(report_rows(spark, sf, d), runs).select(
        "domain", "task", "model", "f1")
    j = ra.join(lb, ["domain", "task", "model"])
    return j.select("domain", "task", "model", TX.fmt_percent("accuracy").alias("accuracy_text"),
                    TX.fmt_fixed("f1").alias("f1_text"), TX.fmt_count("total").alias("total_text"),
                    F.concat(F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("ratio_text"))


# ---------------------------------------------------------------- the same operators on other given tables
def quality_detailed(spark, sf) -> DataFrame:
    """labels as a second truth/prediction pair: truth = quality, prediction = 1 - toxic."""
    lab = T.table(spark, sf, "labels")
    t = F.col("quality").cast("string")
    p = (1 - F.col("toxic")).cast("string")
    return lab.select(F.lit("labels").alias("domain"), F.lit("non_toxic").alias("model"),
                      F.col("doc_id").cast("string").alias("workflow_id"), t.alias("true_class"),
                      p.alias("predicted_class"), (t == p).alias("correct"))


@query
def quality_report(spark, sf):
    rep = C.class_report(quality_detailed(spark, sf))
    return _round_report(rep.unionByName(C.macro_average(rep)))


@query
def quality_confusion(spark, sf):
    return C.confusion_matrix(quality_detailed(spark, sf))


@query
def conversation_texts(spark, sf):
    conv = T.table(spark, sf, "conversations")
    txt = I.ordered_texts(conv, ["conv_id"], "turn", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    return SIM.token_counts(txt, "instance_text").select("conv_id", "n_parts", "num_tokens", "instance_text")
