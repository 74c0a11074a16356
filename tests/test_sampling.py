"""Sampling invariants: distinct workflows per sequence, k in range, contiguous segments,
boundaries = workflows - 1, N smaller than k."""

from pyspark.sql import functions as F

from flowlens.operators import sampling as SA


def instances(spark, n, domain="d"):
    rows = [(domain, f"w{i:03d}", f"P{i % 3}", 1 + i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "domain string, workflow_id string, process_name string, n_events long")


def test_dense_index_is_sorted_rank(spark):
    ix = SA.dense_index(instances(spark, 57).union(instances(spark, 9, "e")))
    got = {(r.domain, r.workflow_id): r.idx for r in ix.collect()}
    for dom, n in (("d", 57), ("e", 9)):
        assert [got[(dom, f"w{i:03d}")] for i in range(n)] == list(range(n))


def test_plan_properties(spark):
    ix = SA.dense_index(instances(spark, 40))
    plan = SA.sample_plan(ix, num_samples=60, min_workflows=2, max_workflows=4, seed=11).collect()
    by = {}
    for r in plan:
        by.setdefault(r.sample, []).append(r)
    assert len(by) == 60
    for rs in by.values():
        k = rs[0].k
        assert 2 <= k <= 4 and len(rs) == k
        assert sorted(r.slot for r in rs) == list(range(1, k + 1))
        assert len({r.idx for r in rs}) == k and all(0 <= r.idx < 40 for r in rs)
    # deterministic given the seed
    again = SA.sample_plan(ix, num_samples=60, seed=11).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))


def test_small_population(spark):
    ix = SA.dense_index(instances(spark, 2))
    plan = SA.sample_plan(ix, num_samples=10, min_workflows=3, max_workflows=4).collect()
    by = {}
    for r in plan:
        by.setdefault(r.sample, set()).add(r.idx)
    assert all(v == {0, 1} for v in by.values()) and len(by) == 10


def test_segments_contiguous(spark):
    ix = SA.dense_index(instances(spark, 30))
    slots = SA.sequence_slots(SA.sample_plan(ix, num_samples=25), ix)
    hd = {r.sequence_id: r for r in SA.sequence_headers(slots).collect()}
    for r in hd.values():
        b = r.segment_boundaries
        assert b[0] == 0 and b[-1] == r.sequence_length and all(x < y for x, y in zip(b, b[1:]))
        assert len(b) - 2 == r.num_workflows - 1
        assert len(set(r.workflow_ids)) == r.num_workflows
    tb = SA.true_boundaries(slots).groupBy("sequence_id").count().collect()
    assert all(c["count"] == hd[c.sequence_id].num_workflows - 1 for c in tb)
    seg = SA.true_segments(slots).withColumn("w", F.col("end_index") - F.col("start_index") + 1)
    assert seg.where("w < 1").count() == 0


def test_zero_workflow_samples(spark):
    # Q10: min_workflows = 0 is honoured; a sample drawing k = 0 is an empty sequence
    ix = SA.dense_index(instances(spark, 20))
    plan = SA.sample_plan(ix, num_samples=40, min_workflows=0, max_workflows=1, seed=5)
    slots = SA.sequence_slots(plan, ix)
    hd = SA.sequence_headers(slots, plan=plan).collect()
    assert len(hd) == 40
    ks = {r.sample: r.k for r in plan.select("sample", "k").distinct().collect()}
    for r in hd:
        assert r.num_workflows == ks[r.sample]
        if r.num_workflows == 0:
            assert r.segment_boundaries == [0] and r.sequence_length == 0
    assert any(k == 0 for k in ks.values()) and any(k == 1 for k in ks.values())
