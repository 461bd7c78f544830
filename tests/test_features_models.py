import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loanlab.catalog import FeatureCatalog
from loanlab.operators import bagging as BG, features as FE, models as M, split as S, validate as VA
from loanlab.operators.adaboost import AdaBoost
from loanlab.operators.discriminant import DiscriminantAnalysis

CAT = FeatureCatalog()


def _raw(spark):
    rows = [(1, "Jan-2015", "B3", " 36 months", "RENT", 100.0, None),
            (2, "Feb-2015", "A1", " 60 months", None, 50.0, 2.0),
            (3, None, "G5", " 36 months", "OWN", None, 3.0),
            (4, "Jan-1960", "C2", " 60 months", "RENT", 10.0, 1.0)]
    return spark.createDataFrame(rows, "id long, issue_d string, sub_grade string, term string, "
                                       "home_ownership string, loan_amnt double, dti double")


def test_vector_form_equals_flat_form(spark):
    df = _raw(spark)
    cols = [c for c in df.columns if c != "id"]
    model = FE.feature_pipeline(cols, CAT).fit(df)
    names = FE.feature_names(model, cols, CAT)
    assert names == ["issue_d", "home_ownership_OWN", "home_ownership_RENT", "term_ 36 months",
                     "term_ 60 months", "sub_grade", "dti", "loan_amnt"]
    vec = {(r.id, r.feature): r.value for r in FE.vector_long(model.transform(df), names).collect() if r.value != 0}
    flat = {(r.id, r.feature): r.value for r in FE.predictors_long(df, CAT).collect() if r.value != 0}
    assert vec == flat
    row2 = [r for r in model.transform(df).collect() if r.id == 2][0].features.toArray()
    assert row2[1] == 0 and row2[2] == 0                     # missing category -> all zeros
    assert flat[(3, "issue_d")] == -99.0 and flat[(4, "issue_d")] == -99.0   # missing, pre-1970
    assert flat[(1, "dti")] == -99.0 and flat[(3, "sub_grade")] == 35.0


def test_chi2_and_refusal(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (0, 2.0, 1.0), (1, 3.0, 5.0), (1, 0.0, 4.0)], "label int, a double, b double")
    got = {r.feature: r.chi2 for r in FE.chi2_scores(df, "label", ["a", "b"]).collect()}
    # a: class sums 3, 3 vs expected 3, 3 -> 0; b: 1, 9 vs 5, 5 -> 16/5 + 16/5
    assert got["a"] == pytest.approx(0.0) and got["b"] == pytest.approx(6.4)
    assert FE.select_k_best(FE.chi2_scores(df, "label", ["a", "b"]), 1) == ["b"]
    with pytest.raises(ValueError):
        FE.chi2_scores(spark.createDataFrame([(0, -1.0)], "label int, a double"), "label", ["a"])


def test_standardize_skew_weights(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (100.0, 1.0)], "x double, c double")
    z = [r.x for r in FE.standardize(df, ["x", "c"]).collect()]
    assert np.allclose(z, (np.array([1, 2, 3, 100.0]) - 26.5) / np.array([1, 2, 3, 100.0]).std())
    _, chosen = FE.log_skewed(df, ["x", "c"], 1.0)
    assert chosen == ["x"]
    w = FE.sample_weight(spark.createDataFrame([(1,), (0,)], "label int"), "label", 5.0).collect()
    assert [r.weight for r in w] == [5.0, 1.0]
    cw = FE.class_weights(spark.createDataFrame([("a",), ("b",)], "s string"), "s", {"a": 10.0}).collect()
    assert sorted((r.s, r.weight) for r in cw) == [("a", 10.0), ("b", 1.0)]


def _signal(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x1 = rng.normal(size=n) + 2.0 * y
    x2 = rng.normal(size=n) - 1.0 * y
    rows = [(int(i), float(y[i]), [float(x1[i]), float(x2[i])]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>")
    return df.select("id", "label", array_to_vector("x").alias("features")), x1, x2, y


def test_discriminant_closed_form(spark):
    df, x1, x2, y = _signal(spark)
    m = DiscriminantAnalysis().fit(df)
    X = np.column_stack([x1, x2])
    mu = np.array([X[y == k].mean(0) for k in (0, 1)])
    Sw = sum((X[y == k] - mu[k]).T @ (X[y == k] - mu[k]) for k in (0, 1)) / (len(y) - 2)
    w = np.linalg.solve(Sw, mu[1] - mu[0])
    pri = np.array([(y == 0).mean(), (y == 1).mean()])
    b = -0.5 * (mu[1] @ np.linalg.solve(Sw, mu[1]) - mu[0] @ np.linalg.solve(Sw, mu[0])) + math.log(pri[1] / pri[0])
    gw, gb = m.binary_coefficients()
    assert np.allclose(gw, w, rtol=1e-6) and gb == pytest.approx(b, rel=1e-6)
    out = m.transform(df).select(vector_to_array("probability").alias("p"), "prediction", "label").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in out)
    assert np.mean([r.prediction == r.label for r in out]) > 0.8


def test_adaboost_first_round_and_probabilities(spark):
    df, *_ = _signal(spark, 300, 2)
    m = AdaBoost(maxIter=5).fit(df)
    assert 1 <= len(m.stumps) <= 5
    stump = m.stumps[0].copy().setFeaturesCol("features").setPredictionCol("prediction")
    pred = stump.transform(df).select("prediction", "label").collect()
    err = np.mean([r.prediction != r.label for r in pred])
    assert m.alphas[0] == pytest.approx(math.log((1 - err) / err), rel=1e-9)
    out = m.transform(df).select(vector_to_array("probability").alias("p"), "prediction", "label").collect()
    assert all(0 <= v <= 1 for r in out for v in r.p)
    assert np.mean([r.prediction == r.label for r in out]) > 0.75


def test_forest_oob_cv_save_load(spark, tmp_path):
    df, *_ = _signal(spark, 300, 3)
    rf = M.random_forest(10, max_depth=4).fit(df)
    p = rf.transform(df).select(vector_to_array("probability").alias("p")).collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in p)
    assert sum(rf.featureImportances.toArray()) == pytest.approx(1.0)
    trees = BG.fit_bagged_trees(df, num_trees=5, max_depth=4)
    o = BG.oob_predict(df, trees).collect()
    w = df.select("id", *[BG.poisson_weight("id", t, 345).alias(f"w{t}") for t in range(5)]).collect()
    has_oob = {r.id: any(r[f"w{t}"] == 0 for t in range(5)) for r in w}
    assert all((r.oob_prediction is not None) == has_oob[r.id] for r in o)
    assert BG.oob_score(df, trees).first().oob_accuracy > 0.7
    folded = S.stratified_k_fold(df, "label", 3, 234)
    oof = VA.cross_val_predict(M.random_forest(5, max_depth=4), folded)
    ids = [r.id for r in oof.collect()]
    assert sorted(ids) == sorted(r.id for r in df.collect())   # every row exactly once
    curve = VA.learning_curve(M.random_forest(5, max_depth=3), folded, sizes=(0.3, 1.0)).collect()
    small = {r.fold: r.n_train for r in curve if r.size == 0.3}
    big = {r.fold: r.n_train for r in curve if r.size == 1.0}
    assert all(small[f] < big[f] for f in small)
    from pyspark.ml import Pipeline, PipelineModel
    pm = Pipeline(stages=[M.random_forest(5, max_depth=3)]).fit(df)
    pm.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a = [r.score for r in M.score(pm, df).orderBy("id").collect()]
    b = [r.score for r in M.score(back, df).orderBy("id").collect()]
    assert a == b


def test_auc_signal_vs_shuffled_labels(spark):
    from loanlab.operators import evaluate as V
    df, *_ = _signal(spark, 600, 7)
    tr = S.train_test_split(df, 0.3, 123)
    m = M.random_forest(10, max_depth=4).fit(tr.filter(~F.col("is_test")))
    auc = V.auc(M.score(m, tr.filter(F.col("is_test")))).first().auc
    assert auc > 0.85
    # labels re-assigned by a hash of the id: no relation to the features
    shuf = tr.withColumn("label", (S.hash_share("id", 99) < 0.5).cast("double"))
    m2 = M.random_forest(10, max_depth=4).fit(shuf.filter(~F.col("is_test")))
    auc2 = V.auc(M.score(m2, shuf.filter(F.col("is_test")))).first().auc
    assert abs(auc2 - 0.5) < 0.12


@pytest.mark.parametrize("kind", ["adaboost", "discriminant"])
def test_custom_models_save_and_load(spark, tmp_path, kind):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.linalg import Vectors

    from loanlab.sources import model_io
    rows = [(Vectors.dense([(i * 37 % 100) / 100.0, (i * 61 % 90) / 90.0]), float((i * 37 % 100) + (i * 61 % 90) > 95))
            for i in range(200)]
    df = spark.createDataFrame(rows, ["f", "label"])
    learner = AdaBoost(maxIter=3, featuresCol="f") if kind == "adaboost" else DiscriminantAnalysis(featuresCol="f")
    model = Pipeline(stages=[learner]).fit(df)
    expected = model.transform(df).select("probability", "prediction").collect()
    model_io.save_model(model, str(tmp_path / "pipe"))
    model_io.save_model(model.stages[0], str(tmp_path / "alone"))
    model_io.save_model(learner, str(tmp_path / "learner"))
    back = model_io.load_model(str(tmp_path / "pipe"), PipelineModel)
    alone = model_io.load_model(str(tmp_path / "alone"), type(model.stages[0]))
    for m in (back, alone):
        assert m.transform(df).select("probability", "prediction").collect() == expected
    assert model_io.load_model(str(tmp_path / "learner"), type(learner)).getFeaturesCol() == "f"
