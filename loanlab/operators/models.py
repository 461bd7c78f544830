"""Model wrappers (Spark ML learners), scoring and feature importance.

Differences from the reference's learners are deliberate and documented:
trees use binned thresholds (``maxBins``) and a depth limit (<= 30) and have
no min-split parameter (``minInstancesPerNode`` is used); boosting has no
second-order terms; the one-vs-rest linear models use L-BFGS/OWL-QN.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from . import forest as FO
from .boost import FirstOrderBoost

SPARK_DEPTH = 20


def random_forest(num_trees: int = 50, max_depth: int = 12, min_instances: int = 1,
                  max_bins: int = 64, seed: int = 345, label: str = "label",
                  features: str = "features", weight: str | None = None) -> RandomForestClassifier | DeepForest:
    """MOD-1/MOD-2: random forest, sqrt features per split, bootstrap.

    Node ids are cached between passes (checkpointed every 10 levels into
    the shared checkpoint folder) and up to 1 GB of split statistics are
    gathered per pass: fewer passes over the training data for deep trees.
    Trees deeper than ``SPARK_DEPTH`` are grown by ``deep_forest``, which needs
    an id column and is no pipeline stage.
    """
    if max_depth > SPARK_DEPTH and min_instances == 1:
        return deep_forest(num_trees, max_depth, 2, max_bins, seed, label, features, weight)
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_instances,
                                maxBins=max_bins, featureSubsetStrategy="sqrt", seed=seed,
                                labelCol=label, featuresCol=features, bootstrap=True,
                                cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=1024)
    if weight:
        rf.setWeightCol(weight)
    return rf


class DeepForest:
    """MOD-1/MOD-2 without a practical depth limit: sqrt features per split, bootstrap, Gini, all
    trees grown jointly (``forest``). Spark's own forest keeps its nodes on the driver and passes
    over all rows for each group of them, which deep trees on many rows do not allow."""

    def __init__(self, num_trees: int, max_depth: int, min_split: int, max_bins: int, seed: int, label: str, features: str,
                 weight: str | None):
        self.trees, self.options = num_trees, (max_depth, min_split, max_bins, seed)
        self.label, self.features, self.weight = label, features, weight

    def fit(self, df: DataFrame) -> DeepForestModel:
        classes = max(2, int(df.agg(F.max(self.label)).first()[0]) + 1)
        forest = FO.grow(df, [FO.Fit("all", self.trees)], classes, *self.options, label=self.label, features=self.features,
                         weight=self.weight)
        p = len(forest.bounds)
        by = {int(r.feature): r.importance for r in FO.importance(forest, [str(i) for i in range(p)]).collect()}  # p values
        return DeepForestModel(forest, Vectors.dense([by[i] for i in range(p)]), self.label, self.features)


class DeepForestModel:
    """``transform`` keeps the id, the label and other plain columns and adds probability and prediction."""

    def __init__(self, forest: FO.Forest, importances, label: str, features: str):
        self.forest, self.featureImportances, self.label, self.features = forest, importances, label, features

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [f.name for f in df.schema if not isinstance(f.dataType, VectorUDT) and f.name not in ("id", self.label)]
        out = FO.score(self.forest, df.drop(*{"probability", "prediction"} & set(df.columns)), label=self.label,
                       features=self.features, keep=[c for c in keep if c not in ("probability", "prediction")])
        return out.drop("score", "used").withColumns({
            "probability": array_to_vector("probability"), "prediction": F.col("prediction").cast("double")})


def deep_forest(num_trees: int = 50, max_depth: int = 30, min_split: int = 2, max_bins: int = 64, seed: int = 345,
                label: str = "label", features: str = "features", weight: str | None = None) -> DeepForest:
    """MOD-1/MOD-2 for trees of any depth up to 30; ids must be distinct."""
    return DeepForest(num_trees, max_depth, min_split, max_bins, seed, label, features, weight)


def gradient_boosted_trees(max_depth: int = 4, max_iter: int = 100, step: float = 0.1,
                           seed: int = 0, label: str = "label", features: str = "features",
                           max_bins: int = 64) -> FirstOrderBoost:
    """MOD-8: gradient-boosted trees (logistic loss, first-order leaves). Nothing is drawn, so
    ``seed`` changes nothing, as in Spark's ``GBTClassifier`` without subsampling."""
    return FirstOrderBoost(maxDepth=max_depth, maxIter=max_iter, stepSize=step, labelCol=label, featuresCol=features,
                           maxBins=max_bins)


def ovr_logistic(reg: float = 1e-4, max_iter: int = 100, label: str = "label",
                 features: str = "features", parallelism: int = 4) -> Pipeline:
    """MOD-5: standardised features, one-vs-rest logistic regression."""
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    lr = LogisticRegression(regParam=reg, maxIter=max_iter, featuresCol="_scaled", labelCol=label)
    return Pipeline(stages=[scaler, OneVsRest(classifier=lr, labelCol=label, featuresCol="_scaled",
                                              parallelism=parallelism)])


def ovr_linear_svm(reg: float = 1e-4, max_iter: int = 100, label: str = "label",
                   features: str = "features", parallelism: int = 4) -> Pipeline:
    """MOD-6: one-vs-rest linear SVM."""
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    svm = LinearSVC(regParam=reg, maxIter=max_iter, featuresCol="_scaled", labelCol=label)
    return Pipeline(stages=[scaler, OneVsRest(classifier=svm, labelCol=label, featuresCol="_scaled",
                                              parallelism=parallelism)])


def linear_svm(reg: float = 1e-4, max_iter: int = 100, label: str = "label",
               features: str = "features") -> Pipeline:
    """MOD-7: large-margin classifier on standardised features (the kernel
    machine re-aimed as a linear one); decision score = rawPrediction[1]."""
    scaler = StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True)
    svm = LinearSVC(regParam=reg, maxIter=max_iter, featuresCol="_scaled", labelCol=label)
    return Pipeline(stages=[scaler, svm])


def score(model, df: DataFrame, keep=("id", "label"), prob_col: str = "probability",
          raw_col: str = "rawPrediction") -> DataFrame:
    """MOD-9: predictions and the positive-class score.

    score = probability[1] when the model gives probabilities, else
    rawPrediction[1] (margin models)."""
    out = model.transform(df)
    cols = [c for c in keep if c in out.columns]
    if prob_col in out.columns:
        s = vector_to_array(F.col(prob_col))[1]
    else:
        s = vector_to_array(F.col(raw_col))[1]
    return out.select(*cols, F.col("prediction").cast("int").alias("prediction"), s.alias("score"))


def feature_importance(model, names: list) -> DataFrame:
    """MOD-10: (feature, importance) from a fitted tree ensemble (bounded: one
    value per feature)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, [float(v) for v in imp])), "feature string, importance double")


def top_k_importance(importances: DataFrame, k: int = 10) -> DataFrame:
    """SRT-4: the k most important features (a top-k report)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def top_indices(importances: DataFrame, names: list, k: int) -> list:
    """Vector slot indices of the k best features, in slot order."""
    best = [r["feature"] for r in top_k_importance(importances, k).collect()]
    pos = {n: i for i, n in enumerate(names)}
    return sorted(pos[b] for b in best)


def slice_features(df: DataFrame, indices: list, features: str = "features",
                   out: str = "features_k") -> DataFrame:
    """PRJ-5 / FEA-9: project the vector to the chosen slots."""
    return VectorSlicer(inputCol=features, outputCol=out, indices=list(indices)).transform(df)
