"""No operator loses rows: NULL keys, outliers, negatives, size switches."""

import pytest
from pyspark.sql import functions as F

from loanlab.operators import distribution as D, evaluate as V, explore as E, split as S


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], (i * 7) % 11 / 11.0, int((i * 5) % 4 == 0)) for i in range(60)]
    return spark.createDataFrame(rows, "id int, model string, score double, label int").withColumn(
        "prediction", (F.col("score") > 0.5).cast("int"))


def test_null_group_is_a_group_with_any_number_of_buckets(scored):
    one = sorted(map(str, V.auc(scored, group=["model"], buckets=1).collect()))
    four = V.auc(scored, group=["model"], buckets=4).collect()
    assert len(four) == 3
    assert [x.split("auc=")[0] for x in one] == sorted(str(r).split("auc=")[0] for r in four)
    assert sorted(round(r.auc, 9) for r in four) == sorted(
        round(r.auc, 9) for r in V.auc(scored, group=["model"], buckets=1).collect())
    assert V.model_comparison(scored).count() == 3


def test_splits_keep_rows_with_null_labels_and_ids(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i, None if i % 3 == 0 else i % 2) for i in range(30)],
                               "id int, label int")
    assert S.stratified_k_fold(df, "label", 3).count() == 30
    flagged = S.train_test_split(df, 0.3, exact=True)
    assert flagged.count() == 30 and flagged.where("is_test").count() == 9


def test_density_has_every_grid_point(spark):
    df = spark.createDataFrame([(i / 1000.0,) for i in range(1000)] + [(1e6,)], "v double")
    assert D.kde(df, "v", grid_points=100).count() == 100
    flat = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [tuple(r) for r in D.kde(flat, "v").collect()] == [(0, 2.0, None)]


@pytest.mark.parametrize("far", [None, 50.0, 1e6])
def test_density_is_the_exact_sum_however_skewed(spark, far):
    import numpy as np
    v = np.append(np.random.default_rng(5).uniform(size=30_000), [] if far is None else [far])
    rows = sorted(D.kde(spark.createDataFrame([(float(x),) for x in v], "v double"), "v").collect())
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 100)
    exact = np.array([np.exp(-0.5 * ((g - v) / h) ** 2).sum() for g in x]) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.x for r in rows], x, rtol=1e-9, atol=1e-9 * h)
    assert np.allclose([r.density for r in rows], exact, rtol=1e-8, atol=1e-13 * exact.max())


def test_bincount_refuses_negative_values(spark):
    with pytest.raises(Exception, match="negative"):
        E.bincount(spark.createDataFrame([(-1,), (1,)], "v int"), "v").collect()


def test_adaboost_label_is_the_weighted_vote(spark):
    from pyspark.ml.linalg import Vectors

    from loanlab.operators.adaboost import AdaBoost
    rows = [(Vectors.dense([(i * 37 % 100) / 100.0, (i * 61 % 100) / 100.0]), float((i * 37 % 100) + (i * 61 % 100) > 95))
            for i in range(300)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = AdaBoost(maxIter=5).fit(df)
    out = model.transform(df).select("features", "prediction").collect()
    for r in out[:60]:
        tally = [0.0, 0.0]
        for s, a in zip(model.stumps, model.alphas):
            tally[int(s.predict(r.features))] += a
        assert r.prediction == float(tally.index(max(tally)))


@pytest.mark.parametrize("gap", ["label", "score", "prediction"])
@pytest.mark.parametrize("name", ["auc", "roc_curve", "pr_curve", "threshold_sweep", "binary_metrics"])
def test_evaluation_refuses_null(scored, name, gap):
    if (gap == "prediction") != (name == "binary_metrics") and gap != "label":
        return  # not read
    holed = scored.withColumn(gap, F.when(F.col("id") != 7, F.col(gap)))
    with pytest.raises(Exception, match=f"NULL in {gap}"):
        getattr(V, name)(holed, *([[0.2, 0.5]] if name == "threshold_sweep" else [])).collect()


def test_split_by_selection_moves_no_rows(spark, monkeypatch):
    df = spark.range(5000).withColumn("x", F.rand(1))
    ranked = {r.id for r in S.hash_rank(df, "id", 123, out="r").where("r <= 1500").collect()}
    for at_once in (10_000, 3):  # one level, and down to single digits
        monkeypatch.setattr(S, "AT_ONCE", at_once)
        flagged = S.train_test_split(df, 0.3, 123)
        assert {r.id for r in flagged.where("is_test").collect()} == ranked and flagged.count() == 5000
        assert "Exchange" not in flagged._jdf.queryExecution().toString()
    odd = spark.createDataFrame([(None,)] * 7 + [(1,)] * 5 + [(i,) for i in range(2, 30)], "id int")
    for share in (0.0, 0.1, 0.175, 0.2, 0.25, 0.5, 1.0):
        flagged = S.train_test_split(odd, share)
        assert flagged.count() == 40 and flagged.where("is_test").count() == -(-round(share * 40 * 1000) // 1000)
    assert S.train_test_split(odd.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("column", ["label", "prediction"])
def test_null_labels_and_predictions_are_refused(scored, column):
    bad = scored.withColumn(column, F.when(F.col("id") != 3, F.col(column)))
    for run in (lambda: V.model_comparison(bad).collect(), lambda: V.error_analysis(bad, "model").collect(),
                *([lambda: V.null_classifier(bad).collect()] if column == "label" else [])):
        with pytest.raises(Exception, match=f"NULL in {column}"):
            run()


def test_nan_is_missing_in_a_density_and_curves_keep_no_cache(spark, scored):
    a = D.kde(spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double"), "v").collect()
    b = D.kde(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    V.roc_curve(scored).count()
    V.auc(scored).count()
    V.threshold_for_recall(scored, 0.5).count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
