"""S1 (JSON array events), S3/S4 (embedding CSV round trip), S2 (definitions file)."""

import json
import os

from pyspark.sql import functions as F

from flowlens.sources.definitions import read_definitions
from flowlens.sources.embeddings import read_embedding_csv
from flowlens.sources.events import land_events, read_events
from flowlens.sources.sinks import write_embeddings


def test_read_events_json_array(spark, tmp):
    rows = [{"process_instance_uuid": "a", "time_stamp": "2024-01-01T10:00:00", "process_name": "P",
             "application_name": "app", "description": f"e{i}", "screen_name": "s", "ignored": 1} for i in range(5)]
    src = os.path.join(tmp, "hr.json")
    json.dump(rows, open(src, "w"), indent=2)
    ev = read_events(spark, src)
    got = ev.orderBy("read_id").collect()
    assert [r.description for r in got] == [f"e{i}" for i in range(5)]
    assert {r.domain for r in got} == {"hr"} and "ignored" not in ev.columns
    landed = land_events(spark, src, os.path.join(tmp, "landed"))
    assert landed.where(F.col("domain") == "hr").count() == 5


def test_landed_order_over_many_files(spark, tmp):
    # several arrays and several files of lines, cut into blocks; order: file name, block, position
    src = os.path.join(tmp, "src")
    os.makedirs(src)
    want = []
    for f in range(5):
        rows = [{"process_instance_uuid": "a", "description": f"{f}-{i}"} for i in range(40 + f)]
        want += [r["description"] for r in rows]
        with open(os.path.join(src, f"{f}.json"), "w") as out:
            out.writelines(json.dumps(r) + "\n" for r in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")       # bytes: a file is read by several tasks
    try:
        landed = land_events(spark, src + "/*.json", os.path.join(tmp, "landed"), "jsonl")
        assert spark.read.parquet(os.path.join(tmp, "landed")).select("block_start").distinct().count() > 1
        got = [(r.event_seq, r.description) for r in landed.orderBy("event_seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(want))
    assert set(landed.columns) >= {"event_seq", "domain"} and "read_id" not in landed.columns


def test_embedding_csv_round_trip(spark, tmp):
    df = spark.createDataFrame([("u1", "P", "line one\nline \"two\"", 3, [0.25, -1.5, 1e-7])],
                               "process_instance_uuid string, process_name string, process_instance_text string, "
                               "num_tokens int, embedding array<double>")
    path = os.path.join(tmp, "emb")
    write_embeddings(df, path, fmt="csv")
    back = read_embedding_csv(spark, path).collect()[0]
    assert back.embedding == [0.25, -1.5, 1e-7] and back.process_instance_text == "line one\nline \"two\""


def test_definitions_file(spark, tmp):
    p = os.path.join(tmp, "defs.json")
    json.dump([{"name": "B", "description": "second"}, {"name": "A", "description": "first"}], open(p, "w"))
    d = read_definitions(spark, p).orderBy("def_pos").collect()
    assert [(r.def_pos, r.name) for r in d] == [(0, "B"), (1, "A")]
