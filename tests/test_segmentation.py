"""Boundary metrics, edit distance and roll-ups on hand-made sequences (Q6, Q8)."""

import random
import time

import pytest
from pyspark.sql import functions as F

from flowlens.functions.arrays import boundary_metrics, edit_distance
from flowlens.operators import segmentation as SG

# true, predicted, length, tolerance -> precision, recall, F1; worked by hand
METRICS = [
    ([10], [9, 10, 11], 20, 0, (1 / 3, 1.0, 0.5)),
    ([10], [9, 10, 11], 20, 1, (1.0, 3.0, 1.5)),        # Q6: three predictions near one boundary
    ([10], [9, 10, 11], 20, 3, (1.0, 3.0, 1.5)),
    ([], [], 5, 0, (0.0, 0.0, 0.0)),                    # one-workflow sequence, nothing predicted
    ([], [], 5, 3, (0.0, 0.0, 0.0)),
    ([5, 12], [], 20, 0, (0.0, 0.0, 0.0)),              # empty predictions
    ([5, 12], [], 20, 3, (0.0, 0.0, 0.0)),
    ([5, 12], [5, 5, 30, -1], 20, 0, (1.0, 0.5, 2 / 3)),   # exact: duplicates collapse, out of range is ignored
    ([5, 12], [5, 5, 30, -1], 20, 1, (0.5, 1.0, 2 / 3)),   # tolerant: both count
    ([3, 8], [8, 3], 10, 0, (1.0, 1.0, 1.0)),
    ([3, 8], [6], 10, 1, (0.0, 0.0, 0.0)),
    ([3, 8], [6], 10, 3, (1.0, 0.5, 2 / 3)),
]


@pytest.mark.parametrize("tol", [0, 1, 3])
def test_boundary_metrics(spark, tol):
    cases = [c for c in METRICS if c[3] == tol]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t array<bigint>, p array<bigint>, n bigint")
    for r in df.select("i", boundary_metrics("t", "p", "n", tol).alias("m")).collect():
        assert (r.m.precision, r.m.recall, r.m.f1) == pytest.approx(cases[r.i][4]), cases[r.i]


DISTANCES = [([], [], 0), ([1], [], 1), ([], [4, 5], 2), ([1, 2, 3], [1, 2, 3], 0), ([1, 2, 3], [1, 3], 1), ([1, 2, 3], [4, 2, 5], 2),
             ([1, 2], [2, 1], 2), ([5, 1, 2, 3], [1, 2, 3, 6], 2), ([7, 7, 7], [7], 2)]


def distances(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<bigint>, b array<bigint>")
    return [r.d for r in df.select("i", edit_distance("a", "b").alias("d")).orderBy("i").collect()]


def test_edit_distance_table(spark):
    assert distances(spark, [(a, b) for a, b, _ in DISTANCES]) == [d for _, _, d in DISTANCES]


def test_edit_distance_is_a_metric(spark):
    random.seed(3)
    some = [[random.randint(0, 6) for _ in range(random.randint(0, 5))] for _ in range(150)]
    a, b, c = some[:50], some[50:100], some[100:]
    ab, ba = distances(spark, list(zip(a, b, strict=True))), distances(spark, list(zip(b, a, strict=True)))
    bc, ac = distances(spark, list(zip(b, c, strict=True))), distances(spark, list(zip(a, c, strict=True)))
    assert ab == ba
    assert all(x <= y + z for x, y, z in zip(ac, ab, bc, strict=True))
    assert all((d == 0) == (x == y) for d, x, y in zip(ab, a, b, strict=True))
    assert all(abs(len(x) - len(y)) <= d <= max(len(x), len(y)) for d, x, y in zip(ab, a, b, strict=True))


def test_evaluate_with_very_many_predicted_boundaries(spark):
    n = 20_000
    text = "<answer>[" + ",".join(f'{{"start_index": {i}, "end_index": {i}}}' for i in range(1, n + 1)) + "]</answer>"
    headers = spark.createDataFrame([("d", "s", 4, 30_000, [0, 10, 20, 30])],
                                    "domain string, sequence_id string, num_workflows int, sequence_length bigint, true_starts array<bigint>")
    resp = spark.createDataFrame([("d", "m", "s", text)], "domain string, model string, sequence_id string, generated_text string")
    began = time.monotonic()
    assert SG.evaluate(headers, resp).select("edit_distance").collect()[0][0] == n - 3
    assert time.monotonic() - began < 10


def test_length_bins_merge_and_equal(spark):
    rows = [("r", f"s{i}", L, f) for i, (L, f) in enumerate([(10, 1.0), (11, 0.5), (12, 0.0), (12, 0.5)])]
    res = spark.createDataFrame(rows, "run string, sequence_id string, sequence_length int, boundary_f1 double")
    # width 0.4 from 10: length 10 lies in the first bin, 11 in the third, 12 in the last
    assert {r.bin_label: r.mean_f1 for r in SG.f1_by_length_bin(res, ("run",)).collect()} == {"10-10": 1.0, "10-11": 0.5, "11-12": 0.25}
    same = spark.createDataFrame([("r", "a", 7, 1.0), ("r", "b", 7, 0.0)],
                                 "run string, sequence_id string, sequence_length int, boundary_f1 double")
    assert {r.bin_label: r.mean_f1 for r in SG.f1_by_length_bin(same, ("run",)).collect()} == {"7-8": 0.5}


def test_evaluate_end_to_end(spark):
    headers = spark.createDataFrame([("d", "s0", 2, 10, [0, 4]), ("d", "s1", 1, 3, [0])],
                                    "domain string, sequence_id string, num_workflows int, sequence_length bigint, "
                                    "true_starts array<bigint>")
    resp = spark.createDataFrame([
        ("d", "m", "s0", '<answer>[{"start_index": 0, "end_index": 4}, {"start_index": 5, "end_index": 9}]</answer>'),
        ("d", "m", "s1", 'no answer')], "domain string, model string, sequence_id string, generated_text string")
    r = {x.sequence_id: x for x in SG.evaluate(headers, resp, tolerance=3).collect()}
    assert r["s0"].boundary_precision == 1.0 and r["s0"].edit_distance == 1
    assert r["s1"].boundary_f1 == 0.0 and r["s1"].edit_distance == 0
    agg = SG.aggregate(SG.evaluate(headers, resp), ("domain", "model")).collect()[0]
    assert agg.boundary_precision == 0.5 and agg.edit_distance == 0.5


@pytest.mark.parametrize("tolerance", [0, 1, 3])
def test_long_metrics_equal_the_array_form(spark, tolerance):
    rng = random.Random(tolerance)
    rows = [("d", "m", f"s{i}", n, [rng.randint(-2, n + 2) for _ in range(rng.randint(0, 6))], [rng.randint(-4, n + 4) for _ in range(rng.randint(0, 9))])
            for i, n in enumerate(rng.randint(5, 40) for _ in range(60))]
    # one sequence of 20,000 predictions, many of them near several true boundaries
    rows.append(("d", "m", "long", 50_000, list(range(0, 50_000, 7)), [rng.randint(0, 60_000) for _ in range(20_000)]))
    df = spark.createDataFrame(rows, "domain string, model string, sequence_id string, sequence_length long, t array<long>, p array<long>")
    small = df.where("sequence_id <> 'long'") if tolerance else df
    m = boundary_metrics("t", "p", "sequence_length", tolerance)
    want = {r.sequence_id: (r.m.precision, r.m.recall, r.m.f1) for r in small.select("sequence_id", m.alias("m")).collect()}
    if tolerance:                                   # the array form compares all pairs; the same count with a sorted list
        import bisect
        _, _, _, _, t, p = rows[-1]
        near = sum(1 for x in p if (i := bisect.bisect_left(t, x - tolerance)) < len(t) and t[i] <= x + tolerance)
        a, b = near / len(p), near / len(t)
        want["long"] = (a, b, 2 * a * b / (a + b))
    true = df.select("domain", "sequence_id", F.explode("t").alias("boundary"))
    pred = df.select("domain", "model", "sequence_id", F.explode("p").alias("boundary"))
    got = {r.sequence_id: (r.boundary_precision, r.boundary_recall, r.boundary_f1)
           for r in SG.boundary_metrics_long(true, pred, df.select("domain", "model", "sequence_id", "sequence_length"), tolerance).collect()}
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-12), s
