"""End-to-end workflows over a loan table.

* ``prepare`` -- clean, (optionally) restrict to application-time features
  and closed loans, label, split exactly by hash rank, assign stratified
  folds, fit the encoding on the training rows only, persist both parts.
* ``approach_one`` -- all features: discriminant analysis, AdaBoost and
  random forest compared by out-of-fold prediction, then on the hold-out
  (accuracy, recall, AUC), importances and the leakage check.
* ``approach_two`` -- application-time features of closed loans: forest,
  learning curve, weighted multiclass forest collapsed to the binary label,
  ROC/PR, a cut-off for a target recall.

The feature encoding is fitted on training rows only (``fit_on='train'``);
``fit_on='all'`` reproduces the reference, which encodes before splitting.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from .. import catalog
from ..functions.expr import is_default
from ..operators import evaluate as V, features as FE, forest as FO, models as M, split as S
from ..operators.adaboost import AdaBoost
from ..operators.discriminant import DiscriminantAnalysis
from ..operators.validate import cross_val_predict
from ..sources.loans import null_sentinel


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    names: list
    pipeline_model: object
    columns: list

    def unpersist(self):
        self.train.unpersist()
        self.test.unpersist()


def prepare(loans: DataFrame, statuses, feature_catalog, application_only: bool = False,
            closed_only: bool = False, test_size: float = 0.3, split_seed: int = 123,
            folds: int = 3, fold_seed: int = 234, fit_on: str = "train",
            extra_keep=("loan_status",)) -> Prepared:
    df = null_sentinel(loans)
    if closed_only:
        df = df.filter(F.col("loan_status").isin(list(statuses.closed)))
    keep_cols = [c for c in df.columns if c not in feature_catalog.exclude]
    if application_only:
        keep_cols = [c for c in keep_cols if c in catalog.APPLICATION or c in ("id", "loan_status")]
    df = df.select(*keep_cols).withColumn("label", is_default("loan_status", statuses.default))
    feat_cols = [c for c in keep_cols if c not in ("id", "loan_status")]
    # the fold ranks, the encoder fit and both encodings re-read the split
    # table: materialise it once, release it when train/test exist
    base = S.train_test_split(df, test_size, split_seed).persist(StorageLevel.MEMORY_AND_DISK)
    df = base
    train_raw = S.stratified_k_fold(df.filter(~F.col("is_test")), "label", folds, fold_seed)
    test_raw = df.filter(F.col("is_test")).withColumn("fold", F.lit(-1))
    pipe = FE.feature_pipeline(feat_cols, feature_catalog)
    # on the training rows before they are ranked into folds: each fit of a stage would rank them again
    model = pipe.fit((df.filter(~F.col("is_test")) if fit_on == "train" else df).select(*feat_cols))
    names = FE.feature_names(model, feat_cols, feature_catalog)
    keep = ["id", "label", "fold"] + [c for c in extra_keep if c in keep_cols]

    def enc(d):
        return model.transform(d.select(*keep, *feat_cols)).select(*keep, "features")

    train = enc(train_raw).persist(StorageLevel.MEMORY_AND_DISK)
    test = enc(test_raw).persist(StorageLevel.MEMORY_AND_DISK)
    train.count()
    test.count()
    base.unpersist()
    return Prepared(train, test, names, model, feat_cols)


def approach_one(prep: Prepared, num_trees: int = 50, ada_rounds: int = 20, max_depth: int = 30, min_split: int = 10):
    """E2: returns (cv_table, test_table, importances)."""
    from functools import reduce
    learners = {"LDA": DiscriminantAnalysis(), "AB": AdaBoost(maxIter=ada_rounds)}
    oof, forest = _forests(prep, num_trees, max_depth, min_split)
    cv_parts = [oof.withColumn("model", F.lit("RF"))]
    test_parts = [FO.score(forest, prep.test, {"all": F.lit(True)}).drop("probability", "used").withColumn("model", F.lit("RF"))]
    for name, est in learners.items():
        cv_parts.append(cross_val_predict(est, prep.train).select(*oof.columns).withColumn("model", F.lit(name)))
        test_parts.append(M.score(est.fit(prep.train), prep.test).withColumn("model", F.lit(name)))
    cv = reduce(lambda a, b: a.unionByName(b), cv_parts)
    test = reduce(lambda a, b: a.unionByName(b), test_parts)
    cv_table = cv.groupBy("model").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        (F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
         / F.count_if(F.col("label") == 1)).alias("recall"))
    test_table = V.model_comparison(test)
    return cv_table, test_table, FO.importance(forest, prep.names, "all")


def _forests(prep: Prepared, num_trees: int, max_depth: int, min_split: int):
    """(out-of-fold scores, forest with the fit "all"): folds and all rows grow in the same passes."""
    folds = sorted(r[0] for r in prep.train.select("fold").distinct().collect())  # k values
    fits = [FO.Fit(str(i), num_trees, F.col("fold") != i) for i in folds] + [FO.Fit("all", num_trees)]
    forest = FO.grow(prep.train, fits, 2, max_depth, min_split)
    oof = FO.score(forest, prep.train, {str(i): F.col("fold") == i for i in folds}, keep=("fold",))
    return oof.select("id", "label", "fold", "prediction", "score"), forest


def approach_two(prep: Prepared, statuses, num_trees: int = 50, max_depth: int = 30, min_split: int = 20,
                 default_weight: float = 5.0, target_recall: float = 0.5):
    """E3 on application-time features of closed loans: returns a dict of
    DataFrames -- out-of-fold accuracy/recall, hold-out metrics of the binary
    forest, the weighted multiclass forest collapsed to default/non-default,
    ROC points, AUC, PR points, the cut-off reaching ``target_recall`` and
    the top-10 importances."""
    from ..operators.validate import cross_val_score
    oof, forest = _forests(prep, num_trees, max_depth, min_split)
    scored = FO.score(forest, prep.test, {"all": F.lit(True)}).drop("probability", "used")
    tr, im = FE.make_multiclass(prep.train)
    tr = tr.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(default_weight))).otherwise(F.lit(1.0)))
    multi = FO.grow(tr, [FO.Fit("all", num_trees)], len(im.labels), max_depth, min_split, label="label_idx", weight="weight")
    pred = FO.score(multi, prep.test, label="label_idx", keep=("label",)).withColumn(
        "prediction", F.col("prediction").cast("double"))
    pred = FE.decode_labels(pred, im, "prediction", "pred_class")
    pred = V.collapse_multiclass(pred, "pred_class", statuses.default, "pred_default")
    return {
        "cv_scores": cross_val_score(oof),
        "cv_metrics": V.binary_metrics(oof),
        "test_metrics": V.binary_metrics(scored),
        "multiclass_metrics": V.binary_metrics(pred.select("label", F.col("pred_default").alias("prediction"))),
        "roc": V.roc_curve(scored),
        "auc": V.auc(scored),
        "pr": V.pr_curve(scored),
        "cutoff": V.threshold_for_recall(scored, target_recall),
        "importance": M.top_k_importance(FO.importance(forest, prep.names, "all"), 10),
    }
