import random

import pytest
from pyspark.sql import functions as F

from loanlab.operators import evaluate as V


def _expand(spark, tn, fp, fn, tp):
    a, b, c = tn, tn + fp, tn + fp + fn
    ids = spark.range(tn + fp + fn + tp)
    i = F.col("id")
    return ids.select("id", F.when(i < b, 0).otherwise(1).alias("label"),
                      F.when(i < a, 0).when(i < b, 1).when(i < c, 0).otherwise(1).alias("prediction"))


def test_golden_matrix_metrics(spark):
    m = V.binary_metrics(_expand(spark, 248556, 19, 984, 16655)).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (248556, 19, 984, 16655)
    assert m.f1 == pytest.approx(0.97076909626089236, abs=1e-15)
    assert m.accuracy == pytest.approx((248556 + 16655) / 266214)
    assert m.recall == pytest.approx(16655 / (16655 + 984))
    cells = {(r.label, r.prediction): r.n for r in V.confusion_matrix(_expand(spark, 5, 0, 3, 0)).collect()}
    assert cells == {(0, 0): 5, (0, 1): 0, (1, 0): 3, (1, 1): 0}   # zero-filled 2x2
    z = V.binary_metrics(_expand(spark, 5, 0, 0, 0)).first()        # one class, no positives predicted
    assert (z.recall, z.precision, z.f1) == (0.0, 0.0, 0.0)
    pct = {(r.label, r.prediction): r.pct for r in V.confusion_share(_expand(spark, 248575, 0, 17639, 0)).collect()}
    assert pct[(0, 0)] == 93.4 and pct[(1, 0)] == 6.6


def _brute(rows):
    """ROC points and trapezoid AUC by plain Python (ties as one point)."""
    P = sum(1 for _, y in rows if y == 1)
    N = len(rows) - P
    pts, tp, fp = [(0.0, 0.0)], 0, 0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp += sum(1 for x, y in rows if x == s and y == 1)
        fp += sum(1 for x, y in rows if x == s and y == 0)
        pts.append((fp / N, tp / P))
    auc = sum((x1 - x0) * (y1 + y0) / 2 for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    return pts, auc


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_roc_auc_tied_scores_match_brute_force(spark, buckets):
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(5)
    pts, auc = _brute(rows)
    got = V.auc(df, buckets=buckets).first().auc
    assert got == pytest.approx(auc, abs=1e-12)
    curve = sorted((r.fpr, r.tpr) for r in V.roc_curve(df, buckets=buckets).collect())
    ref = sorted(pts)
    assert len(curve) == len(ref)
    assert all(abs(a - c) < 1e-12 and abs(b - d) < 1e-12 for (a, b), (c, d) in zip(curve, ref))
    cum = V.cumulative_counts(df, buckets=buckets).orderBy(F.desc("score")).collect()
    assert cum[-1].cum_tp == cum[-1].P and cum[0].prev_tp == 0


def test_sweep_pr_and_recall_target(spark):
    rnd = random.Random(9)
    rows = [(rnd.random(), int(rnd.random() < 0.2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, label int")
    ts = V.linspace(0.1, 0.9, 9)
    got = {round(r.threshold, 9): (r.tp, r.fp, r.fn, r.tn) for r in V.threshold_sweep(df, ts).collect()}
    for t in ts:
        tp = sum(1 for s, y in rows if s > t and y == 1)
        fp = sum(1 for s, y in rows if s > t and y == 0)
        fn = sum(1 for s, y in rows if not s > t and y == 1)
        assert got[round(t, 9)] == (tp, fp, fn, len(rows) - tp - fp - fn)
    pr = V.pr_curve(df).collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in pr)
    assert max(r.recall for r in pr) == 1.0
    t = V.threshold_for_recall(df, 0.5).first()
    P = sum(y for _, y in rows)
    assert sum(1 for s, y in rows if s >= t.threshold and y == 1) / P >= 0.5
    best = V.argmax_threshold(V.threshold_sweep(df, ts), "f1").first()
    assert best.threshold in [round(x, 12) for x in ts] or any(abs(best.threshold - x) < 1e-12 for x in ts)


def test_model_comparison_and_errors(spark):
    rows = [("m1", 1, 0.9, 1, "a"), ("m1", 0, 0.1, 0, "b"), ("m2", 1, 0.2, 0, "a"), ("m2", 0, 0.8, 1, "b")]
    df = spark.createDataFrame(rows, "model string, label int, score double, prediction int, status string")
    got = {r.model: (r.accuracy, r.recall, r.auc) for r in V.model_comparison(df).collect()}
    assert got == {"m1": (1.0, 1.0, 1.0), "m2": (0.0, 0.0, 0.0)}
    ea = {r.status: (r.n, r.n_wrong) for r in V.error_analysis(df, "status").collect()}
    assert ea == {"a": (2, 1), "b": (2, 1)}
    nc = V.null_classifier(df).first()
    assert nc.accuracy == 0.5


def test_auc_and_counts_invariant_under_repartition(spark):
    rnd = random.Random(21)
    rows = [(i, round(rnd.random(), 3), int(rnd.random() < 0.25)) for i in range(800)]
    base = spark.createDataFrame(rows, "id long, score double, label int")
    ref = V.auc(base.coalesce(1)).first().auc
    for parts in (4, 16):
        df = base.repartition(parts)
        assert V.auc(df).first().auc == pytest.approx(ref, abs=1e-12)
        assert V.auc(df, buckets=5).first().auc == pytest.approx(ref, abs=1e-12)
        assert sorted(tuple(r) for r in V.confusion_matrix(V.at_cutoff(df, 0.5)).collect()) == \
            sorted(tuple(r) for r in V.confusion_matrix(V.at_cutoff(base.coalesce(1), 0.5)).collect())
