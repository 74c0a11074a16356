"""Classification metrics against a brute-force Python computation; Q1 and Q5."""

from collections import Counter

from flowlens.operators import classification as C

KEYS = ("run",)


def detailed(spark, pairs, run="r"):
    rows = [(run, f"w{i}", t, p, t == p) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "run string, workflow_id string, true_class string, predicted_class string, "
                                       "correct boolean")


def brute_report(pairs):
    labels = sorted({t for t, _ in pairs})
    out = {}
    for lab in labels:
        tp = sum(1 for t, p in pairs if t == lab and p == lab)
        npred = sum(1 for _, p in pairs if p == lab)
        sup = sum(1 for t, _ in pairs if t == lab)
        pr = tp / npred if npred else 0.0
        rc = tp / sup if sup else 0.0
        f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        out[lab] = (pr, rc, f, sup)
    return out


PAIRS = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "Other"), ("C", "A"), ("C", "Format Error"), ("A", "A")]


def test_class_report_and_macro(spark):
    d = detailed(spark, PAIRS)
    rep = {r.label: (r.precision, r.recall, r.f1_score, r.support) for r in C.class_report(d, KEYS).collect()}
    want = brute_report(PAIRS)
    assert set(rep) == set(want)
    for k in want:
        assert all(abs(a - b) < 1e-12 for a, b in zip(rep[k], want[k]))
    m = C.macro_average(C.class_report(d, KEYS), KEYS).collect()[0]
    assert abs(m.precision - sum(v[0] for v in want.values()) / 3) < 1e-12
    assert m.support == len(PAIRS)


def test_accuracy_row_only_when_predictions_are_true_labels(spark):
    assert C.report_accuracy_row(detailed(spark, PAIRS), KEYS).count() == 0           # Other/Format Error
    clean = [("A", "A"), ("A", "B"), ("B", "B")]
    r = C.report_accuracy_row(detailed(spark, clean), KEYS).collect()[0]
    assert r.label == "accuracy" and abs(r.precision - 2 / 3) < 1e-12 and r.support == r.recall == r.precision
    # a known class that is never true also removes the row
    assert C.report_accuracy_row(detailed(spark, [("A", "A"), ("A", "Z")]), KEYS).count() == 0


def test_confusion_family(spark):
    d = detailed(spark, PAIRS)
    cm = C.confusion_matrix(d, KEYS)
    got = {(r.actual, r.predicted): r.n for r in cm.collect()}
    assert got == dict(Counter(PAIRS))
    rows = {(r.actual, r.predicted): r.percent for r in C.confusion_percent(cm, KEYS).collect()}
    assert abs(rows[("A", "A")] - 200 / 3) < 1e-9
    cols = {(r.actual, r.predicted): r.percent for r in C.confusion_percent(cm, KEYS, "predicted").collect()}
    assert abs(cols[("A", "A")] - 200 / 3) < 1e-9 and abs(cols[("C", "A")] - 100 / 3) < 1e-9
    acc = C.confusion_accuracy(cm, KEYS).collect()[0].accuracy
    assert abs(acc - 3 / 7) < 1e-12
    labels = {r.label for r in C.label_union(d, KEYS).collect()}
    assert labels == {"A", "B", "C", "Other", "Format Error"}


def test_normalize_outcomes(spark):
    ans = spark.createDataFrame([("d", "w1", "A"), ("d", "w2", None), ("d", "w3", ""), ("d", "w4", "a")],
                                "domain string, workflow_id string, answer string")
    labels = spark.createDataFrame([("d", "A")], "domain string, process_name string")
    got = {r.workflow_id: r.predicted_class for r in C.normalize_outcomes(ans, labels).collect()}
    assert got == {"w1": "A", "w2": "Format Error", "w3": "Other", "w4": "Other"}
