"""Registered queries: models, validation and persistence (rows-only
checks: learners are not expressible in SQL). Each reads the given tables
through the loan view (or the embeddings / labels tables)."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import (bagging as BG, evaluate as V, features as FE, forest as FO, models as M, split as S,
                         validate as VA)
from ..operators.adaboost import AdaBoost
from ..operators.boost import NewtonBoost
from ..operators.discriminant import DiscriminantAnalysis
from ..operators.kernel import kernel_svm
from ..operators.sgd import AveragedSGD
from ..session import scratch_path
from ..sources import model_io
from ..sources.fixture import FIXTURE_FEATURES, FIXTURE_STATUSES, table
from .registry import loans, query, rnd
from .workflows import prepare

# The reference's sizes: 50 trees (100 in the grid, 20 in the learning curve), none with a
# depth limit; 30 is the deepest that Spark grows. A node of fewer than 10 rows (all loans) or
# 20 rows (closed loans) is not split.
TREES, GRID_TREES, CURVE_TREES, DEPTH = 50, 100, 20, 30
MIN_SPLIT, MIN_SPLIT_CLOSED = 10, 20

_PREP: dict = {}


def _prep(spark, sf, kind="all"):
    """Encoded, split, persisted training/test tables (reused across queries
    of one session and data folder)."""
    key = (id(spark), sf, kind)
    if key not in _PREP:
        if kind == "all":
            _PREP[key] = prepare(loans(spark, sf), FIXTURE_STATUSES, FIXTURE_FEATURES)
        else:
            _PREP[key] = prepare(loans(spark, sf), FIXTURE_STATUSES, FIXTURE_FEATURES,
                                 application_only=True, closed_only=True)
    return _PREP[key]


@query("random_forest")
def q_random_forest(spark, sf):
    p = _prep(spark, sf)
    m = FO.grow(p.train, [FO.Fit("all", TREES)], max_depth=DEPTH, min_split=MIN_SPLIT)
    return rnd(FO.score(m, p.test).drop("probability", "used"))


@query("predict_proba")
def q_predict_proba(spark, sf):
    p = _prep(spark, sf)
    m = M.random_forest(TREES, max_depth=DEPTH).fit(p.train)
    out = m.transform(p.test)
    arr = vector_to_array("probability")
    return rnd(out.select("id", arr[0].alias("p0"), arr[1].alias("p1"), F.col("prediction").cast("int")))


@query("feature_importance")
def q_feature_importance(spark, sf):
    p = _prep(spark, sf)
    m = M.random_forest(TREES, max_depth=DEPTH).fit(p.train)
    return rnd(M.feature_importance(m, p.names))


@query("top_k_importance")
def q_top_k_importance(spark, sf):
    p = _prep(spark, sf)
    m = M.random_forest(TREES, max_depth=DEPTH).fit(p.train)
    return rnd(M.top_k_importance(M.feature_importance(m, p.names), 10))


@query("select_top_importance")
def q_select_top_importance(spark, sf):
    p = _prep(spark, sf)
    m = M.random_forest(TREES, max_depth=DEPTH).fit(p.train)
    idx = M.top_indices(M.feature_importance(m, p.names), p.names, 20)
    tr = M.slice_features(p.train, idx)
    te = M.slice_features(p.test, idx)
    m2 = M.random_forest(TREES, max_depth=DEPTH, features="features_k").fit(tr)
    return rnd(M.score(m2, te))


@query("select_ranked_features")
def q_select_ranked_features(spark, sf):
    p = _prep(spark, sf)
    m = M.random_forest(TREES, max_depth=DEPTH).fit(p.train)  # ranked by importance, over unchanged features
    idx = sorted(M.top_indices(M.feature_importance(m, p.names), p.names, 5))
    out = M.slice_features(p.test, idx)
    slot = F.array(*[F.lit(p.names[i]) for i in idx])
    return rnd(out.select("id", F.posexplode(vector_to_array("features_k")).alias("i", "value"))
               .select("id", F.element_at(slot, F.col("i") + 1).alias("feature"), "value"))


@query("random_forest_multiclass")
def q_random_forest_multiclass(spark, sf):
    p = _prep(spark, sf, "application")
    tr, im = FE.make_multiclass(p.train)
    te = im.transform(p.test)
    tr = tr.withColumn("weight", F.lit(4.0) * F.col("label") + F.lit(1.0))  # defaults weigh 5
    m = FO.grow(tr, [FO.Fit("all", TREES)], len(im.labels), DEPTH, MIN_SPLIT_CLOSED, label="label_idx", weight="weight")
    pred = FO.score(m, te, label="label_idx", keep=("loan_status", "label")).withColumn(
        "prediction", F.col("prediction").cast("double"))
    pred = FE.decode_labels(pred, im, "prediction", "pred_class")
    pred = V.collapse_multiclass(pred, "pred_class", FIXTURE_STATUSES.default, "pred_default")
    return pred.select("id", "loan_status", "pred_class", F.col("label").alias("true_default"), "pred_default")


@query("adaboost")
def q_adaboost(spark, sf):
    p = _prep(spark, sf)
    m = AdaBoost(maxIter=20).fit(p.train)
    return rnd(M.score(m, p.test))


@query("discriminant_analysis")
def q_discriminant_analysis(spark, sf):
    p = _prep(spark, sf)
    m = DiscriminantAnalysis().fit(p.train)
    return rnd(M.score(m, p.test))


@query("lda_coefficients")
def q_lda_coefficients(spark, sf):
    from pyspark.sql import Window
    p = _prep(spark, sf)
    m = DiscriminantAnalysis().fit(p.train)
    t = m.coefficients_table(p.names)  # one row per feature
    return rnd(t.withColumn("rank_asc", F.row_number().over(Window.orderBy("coef", "feature")))
               .withColumn("rank_desc", F.row_number().over(Window.orderBy(F.desc("coef"), "feature"))))


def _embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("double").alias("label"),
                    array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))


@query("discriminant_multiclass")
def q_discriminant_multiclass(spark, sf):
    e = S.train_test_split(_embeddings(spark, sf), 0.3, seed=123)
    m = DiscriminantAnalysis().fit(e.filter(~F.col("is_test")))
    out = m.transform(e.filter(F.col("is_test")))
    return out.select("id", F.col("label").cast("int"), F.col("prediction").cast("int"))


@query("ovr_logistic")
def q_ovr_logistic(spark, sf):
    e = S.train_test_split(_embeddings(spark, sf), 0.3, seed=123)
    m = M.ovr_logistic(reg=1e-4, max_iter=50).fit(e.filter(~F.col("is_test")))
    return m.transform(e.filter(F.col("is_test"))).select("id", F.col("label").cast("int"),
                                                          F.col("prediction").cast("int"))


def _statuses(spark, sf, default_weight):
    p = _prep(spark, sf)
    tr, im = FE.make_multiclass(p.train)
    tr = FE.class_weights(tr, "loan_status", {s: default_weight for s in FIXTURE_STATUSES.default})
    m = AveragedSGD(labelCol="label_idx", weightCol="weight").fit(tr)
    pred = FE.decode_labels(m.transform(p.test), im, "prediction", "pred_class")
    pred = V.collapse_multiclass(pred, "pred_class", FIXTURE_STATUSES.default, "pred_default")
    return pred.select("id", "loan_status", "pred_class", F.col("label").alias("true_default"), "pred_default")


@query("sgd_statuses")
def q_sgd_statuses(spark, sf):
    """MOD-5 on all loan statuses, decoded and collapsed to default."""
    return _statuses(spark, sf, 1.0)


@query("sgd_statuses_weighted")
def q_sgd_statuses_weighted(spark, sf):
    """FEA-11 in a fit: the default statuses weigh 10."""
    return _statuses(spark, sf, 10.0)


@query("ovr_linear_svm")
def q_ovr_linear_svm(spark, sf):
    e = S.train_test_split(_embeddings(spark, sf), 0.3, seed=123)
    first = S.slice_first(e.filter(~F.col("is_test")), 10_000)  # the expensive learner's subset
    m = M.ovr_linear_svm(max_iter=50).fit(first)
    return m.transform(e.filter(F.col("is_test"))).select("id", F.col("label").cast("int"),
                                                          F.col("prediction").cast("int"))


@query("linear_svm")
def q_linear_svm(spark, sf):
    p = _prep(spark, sf)
    m = M.linear_svm(max_iter=50).fit(p.train)
    return rnd(M.score(m, p.test))


@query("kernel_svm")
def q_kernel_svm(spark, sf):
    p = _prep(spark, sf)
    return rnd(M.score(kernel_svm().fit(p.train), p.test))


@query("standard_scaler_population")
def q_standard_scaler_population(spark, sf):
    """FEA-5 on vectors: Spark's scaler uses the sample std; multiplying by
    sqrt(n/(n-1)) gives the population form."""
    p = _prep(spark, sf)
    n = p.train.count()
    sc = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(p.train)
    f = (n / (n - 1)) ** 0.5
    z = vector_to_array(F.col("z"))
    return rnd(sc.transform(p.test).select("id", F.transform(z, lambda v: v * F.lit(f)).alias("z")))


@query("row_normalize_vector")
def q_row_normalize_vector(spark, sf):
    from pyspark.ml.feature import Normalizer
    p = _prep(spark, sf)
    out = Normalizer(p=2.0, inputCol="features", outputCol="n").transform(p.test)
    return rnd(out.select("id", vector_to_array("n").alias("n")))


@query("gradient_boosted_trees")
def q_gradient_boosted_trees(spark, sf):
    p = _prep(spark, sf, "application")
    m = M.gradient_boosted_trees(max_depth=4, max_iter=100).fit(p.train)
    return rnd(M.score(m, p.test))


@query("newton_boost")
def q_newton_boost(spark, sf):
    """MOD-8 with second-order leaves: depth 4, 100 rounds."""
    p = _prep(spark, sf, "application")
    return rnd(M.score(NewtonBoost().fit(p.train), p.test))


@query("cross_val_predict")
def q_cross_val_predict(spark, sf):
    p = _prep(spark, sf, "application")
    return rnd(VA.forest_cross_val_predict(p.train, TREES, DEPTH, MIN_SPLIT_CLOSED))


@query("cross_val_score")
def q_cross_val_score(spark, sf):
    p = _prep(spark, sf, "application")
    return rnd(VA.cross_val_score(VA.forest_cross_val_predict(p.train, TREES, DEPTH, MIN_SPLIT_CLOSED)))


@query("grid_search")
def q_grid_search(spark, sf):
    p = _prep(spark, sf, "application")
    _, table_ = VA.forest_grid_search(p.train, (TREES, GRID_TREES), (12, DEPTH), (MIN_SPLIT_CLOSED,))
    return rnd(table_)


@query("learning_curve")
def q_learning_curve(spark, sf):
    p = _prep(spark, sf, "application")
    return rnd(VA.forest_learning_curve(p.train, CURVE_TREES, max_depth=DEPTH, min_split=MIN_SPLIT_CLOSED))


@query("learning_curve_means")
def q_learning_curve_means(spark, sf):
    p = _prep(spark, sf, "application")
    curve = VA.forest_learning_curve(p.train, CURVE_TREES, max_depth=DEPTH, min_split=MIN_SPLIT_CLOSED)
    null_acc = V.null_classifier(p.train).first()["accuracy"]
    return rnd(VA.learning_curve_means(curve, null_acc))


@query("oob_score")
def q_oob_score(spark, sf):
    p = _prep(spark, sf, "application")
    forest = BG.fit_bagged_trees(p.train, num_trees=TREES, max_depth=DEPTH, min_split=MIN_SPLIT_CLOSED)
    return rnd(BG.oob_score(p.train, forest))


@query("bagged_forest")
def q_bagged_forest(spark, sf):
    p = _prep(spark, sf, "application")
    forest = BG.fit_bagged_trees(p.train, num_trees=TREES, max_depth=DEPTH, min_split=MIN_SPLIT_CLOSED)
    return rnd(BG.bagged_predict(p.test, forest).select("id", "label", "prediction", "score"))


@query("save_load_model")
def q_save_load_model(spark, sf):
    from pyspark.ml import Pipeline, PipelineModel
    p = _prep(spark, sf)
    model = Pipeline(stages=[M.random_forest(10, max_depth=8)]).fit(p.train)
    path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
    model_io.save_model(model, path)
    back = model_io.load_model(path, PipelineModel)
    a = M.score(model, p.test).select("id", F.col("score").alias("a"))
    b = M.score(back, p.test).select("id", F.col("score").alias("b"))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


@query("save_load_custom_models")
def q_save_load_custom_models(spark, sf):
    """The learners written here, saved and read back alone and inside a pipeline."""
    from pyspark.ml import Pipeline, PipelineModel
    p = _prep(spark, sf)
    out = None
    for name, learner in (("adaboost", AdaBoost(maxIter=3)), ("discriminant", DiscriminantAnalysis())):
        model = Pipeline(stages=[learner]).fit(p.train)
        path = scratch_path(spark, f"model-{uuid.uuid4().hex}")
        model_io.save_model(model, path)
        model_io.save_model(model.stages[0], f"{path}-alone")
        back = model_io.load_model(path, PipelineModel)
        alone = model_io.load_model(f"{path}-alone", type(model.stages[0]))
        scored = [m.transform(p.test).select("id", F.struct("probability", "prediction").alias(c))
                  for m, c in ((model, "a"), (back, "b"), (alone, "c"))]
        row = scored[0].join(scored[1], "id").join(scored[2], "id").agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"),
            F.count_if((F.col("a") == F.col("b")) & (F.col("a") == F.col("c"))).alias("n_equal"))
        out = row if out is None else out.unionByName(row)
    return out


@query("weighted_binary")
def q_weighted_binary(spark, sf):
    """FEA-10 in a model: an imbalanced label (toxic documents) with
    positive-class weights."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    d = d.select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label"),
                 F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    pipe = Pipeline(stages=[
        StringIndexer(inputCols=["lang", "source"], outputCols=["_li", "_si"], handleInvalid="keep"),
        OneHotEncoder(inputCols=["_li", "_si"], outputCols=["_lv", "_sv"]),
        VectorAssembler(inputCols=["n_chars", "_lv", "_sv"], outputCol="features")])
    d = S.train_test_split(d, 0.3, seed=123)
    tr = FE.sample_weight(d.filter(~F.col("is_test")), "label", 5.0)
    fm = pipe.fit(tr)
    m = M.random_forest(20, max_depth=6, weight="weight").fit(fm.transform(tr))
    return rnd(M.score(m, fm.transform(d.filter(F.col("is_test")))))
