"""Instance assembly on hand-made events: Q2 null cells, null timestamps last, file-order ties,
skew-safe positions equal to a brute-force ordering."""

import random

import pytest

from pyspark.sql import functions as F

from flowlens.operators import instances as I
from flowlens.operators.indexing import with_group_index, with_row_index

COLS = "process_instance_uuid string, time_stamp string, process_name string, application_name string, " \
       "description string, screen_name string, event_seq long, domain string"


def events(spark):
    rows = [
        ("a", "2024-01-01 10:00:00", "P1", "app", "open", "s1", 1, "d"),
        ("a", "bad", "P1", "app", "lost", "s2", 2, "d"),               # unparseable -> null -> last
        ("a", "2024-01-01 09:00:00", "P2", "app", None, "s3", 3, "d"),  # earliest -> first; null description
        ("a", "2024-01-01 10:00:00", "P1", None, "tie", "s4", 4, "d"),   # same ts as seq 1 -> after it
        ("b", "2024-01-02 00:00:00", "P3", "app", "x", "s", 5, "d"),
        (None, "2024-01-02 00:00:00", "P3", "app", "orphan", "s", 6, "d"),  # null id -> dropped
    ]
    return I.coerce_timestamps(spark.createDataFrame(rows, COLS))


def test_positions_and_header(spark):
    ev = events(spark)
    pos = {r.event_seq: r.pos for r in I.event_positions(ev).collect()}
    assert pos == {3: 0, 1: 1, 4: 2, 2: 3, 5: 0}
    hdr = {r.workflow_id: (r.process_name, r.n_events) for r in I.workflow_instances(ev).collect()}
    assert hdr == {"a": ("P2", 4), "b": ("P3", 1)}


def test_descriptions_render_none(spark):
    ev = I.with_descriptions(events(spark))
    got = {r.event_seq: r.event_text for r in ev.collect()}
    assert got[3] == "None in the screen s3 of the application app"
    assert got[4] == "tie in the screen s4 of the application None"


def test_instance_texts_skip_null_lines(spark):
    t = {r.workflow_id: r for r in I.instance_texts(events(spark)).collect()}
    assert t["a"].instance_text == "open in the screen s1 of the application app\nlost in the screen s2 of the application app"
    assert t["a"].n_null_lines == 2 and t["a"].process_name == "P1"


def test_label_encoding_sorted(spark):
    # P1 is only on later events of its instance
    lab = I.label_encoding(events(spark)).orderBy("label_id").collect()
    assert [(r.process_name, r.label_id) for r in lab] == [("P1", 0), ("P2", 1), ("P3", 2)]


def test_timestamps_with_offsets(spark):
    texts = ["2024-01-01T10:00:00+02:00", "2024-01-01T09:00:00Z", "2024-01-01 09:30:00.25", "2024-01-01", "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, time_stamp string")
    got = [r.t for r in I.coerce_timestamps(df).select("i", F.col("time_stamp").cast("string").alias("t")).orderBy("i").collect()]
    assert got == ["2024-01-01 08:00:00", "2024-01-01 09:00:00", "2024-01-01 09:30:00.25", "2024-01-01 00:00:00", None]


def test_row_index_matches_sort(spark):
    random.seed(7)
    rows = [(random.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = {r.i: r.row_index for r in with_row_index(df, [F.col("k"), F.col("i")], num_partitions=5).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(rows))}
    assert got == want


def numbered(rows):
    by = {}
    for g, i in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        by.setdefault(g, []).append(i)
    return {(g, i): n for g, found in by.items() for n, i in enumerate(found)}


@pytest.mark.parametrize("piece_rows", [1, 7, 100, 10_000])
def test_group_index_hot_key(spark, piece_rows):
    # one key holds most rows, and a null key some: cut into ranges of any size, the numbers stay exact
    rows = [("hot" if i % 10 else [None, f"k{i}"][i % 20 == 0], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r.g, r.i): r.ix for r in with_group_index(df, ["g"], ["i"], "ix", piece_rows=piece_rows).collect()}
    assert got == numbered(rows)


def test_group_index_over_texts_and_null_times(spark):
    # text keys with a long common start; times of which many are null or equal, told apart by the second column
    names = sorted({f"wf-0000{i * 37 % 1009:05d}-é{i % 7}" for i in range(900)}, key=lambda n: n.encode())
    df = spark.createDataFrame([("d", n) for n in names], "g string, n string").repartition(3)
    got = {r.n: r.ix for r in with_group_index(df, ["g"], ["n"], "ix", piece_rows=20).collect()}
    assert got == {n: i for i, n in enumerate(names)}
    rng = random.Random(3)
    times = [rng.choice([None, "2024-01-01 00:00:00", f"2024-0{rng.randint(1, 9)}-01 0{rng.randint(0, 9)}:00:00"]) for _ in range(800)]
    df = spark.createDataFrame([("u", t, i) for i, t in enumerate(times)], "g string, t string, s int")
    df = df.withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.s: r.ix for r in with_group_index(df, ["g"], ["t", "s"], "ix", piece_rows=25).collect()}
    want = sorted(range(800), key=lambda i: (times[i] is None, times[i] or "", i))
    assert got == {i: n for n, i in enumerate(want)}


def test_a_hot_group_is_dealt_to_ranges_and_nothing_runs_while_planning(spark):
    df = spark.createDataFrame([("hot", i) for i in range(4000)], "g string, i int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    indexed = with_group_index(df, ["g"], ["i"], "ix", piece_rows=100)
    assert not tracker.getJobIdsForGroup("planning")
    assert indexed.agg(F.max("ix")).first()[0] == 3999


def test_positions_are_of_one_domain(spark):
    rows = [(d, "u", f"2024-01-0{i + 1} 00:00:00", i) for d in ("a", "b") for i in range(3)]
    ev = I.coerce_timestamps(spark.createDataFrame(rows, "domain string, process_instance_uuid string, time_stamp string, event_seq long"))
    got = {(r.domain, r.event_seq): r.pos for r in I.event_positions(ev).collect()}
    assert got == {(d, i): i for d in ("a", "b") for i in range(3)}


def test_cluster_conf():
    from flowlens.session import cluster_conf
    c = cluster_conf(100 << 40, 8, 1000)
    assert c["spark.sql.shuffle.partitions"] == str((100 << 40) // 10 // (256 << 20)) and c["spark.sql.adaptive.enabled"] == "true"
    small = cluster_conf(1 << 30, 4, 2)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
