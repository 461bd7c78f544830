"""MOD-4: linear discriminant analysis as a Spark ML Estimator.

Fitting is two distributed passes and a small driver solve:

1. per-feature mean and standard deviation (``Summarizer``), so the
   moments below are computed on centred, scaled values (date features of
   ~1e18 would otherwise destroy the covariance in floating point);
2. one pass of Arrow batches (``mapInPandas``): per partition and class the
   row count, feature sums and the Gram matrix (numpy), emitted once per
   partition; Spark sums them per (class, slot) with partial aggregation;
3. on the driver (p x p, p = feature count): class means, pooled
   within-class covariance, its pseudo-inverse (one-hot blocks are
   collinear), linear discriminant coefficients, and the explained
   variance ratio of the discriminant directions.

Scoring takes Arrow batches (dot products, softmax); a column expression
would read a row's vector again for each class and each use of its scores.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .forest import matrix
from ._persist import SavedState

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _LDAParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    probabilityCol = Param(Params._dummy(), "probabilityCol", "class probabilities column",
                           typeConverter=TypeConverters.toString)
    rawPredictionCol = Param(Params._dummy(), "rawPredictionCol", "discriminant scores column",
                             typeConverter=TypeConverters.toString)
    tol = Param(Params._dummy(), "tol", "relative eigenvalue cut-off of the pseudo-inverse",
                typeConverter=TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", rawPredictionCol="rawPrediction", tol=1e-4)


def _moments(batches, p, mean, scale, feat, label):
    acc = {}
    for pdf in batches:
        if len(pdf) == 0:
            continue
        X = (np.stack(pdf[feat].to_numpy()) - mean) / scale
        y = pdf[label].to_numpy()
        for k in np.unique(y):
            Xi = X[y == k]
            n, s, g = acc.get(k, (0, np.zeros(p), np.zeros((p, p))))
            acc[k] = (n + len(Xi), s + Xi.sum(0), g + Xi.T @ Xi)
    import pandas as pd
    for k, (n, s, g) in acc.items():
        yield pd.DataFrame({"cls": [float(k)], "n": [int(n)], "s": [s.tolist()], "g": [g.ravel().tolist()]})


class DiscriminantAnalysis(Estimator, _LDAParams, DefaultParamsReadable, DefaultParamsWritable):
    """Linear discriminant analysis (shared covariance), any number of classes."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", rawPredictionCol="rawPrediction", tol=1e-4):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        feat, label = self.getFeaturesCol(), self.getLabelCol()
        st = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(feat)).alias("s")).first()["s"]
        mean = st["mean"].toArray()
        scale = np.sqrt(st["variance"].toArray())
        scale[scale == 0] = 1.0
        p = len(mean)
        arr = df.select(vector_to_array(F.col(feat)).alias("x"), F.col(label).cast("double").alias("y"))
        parts = arr.mapInPandas(lambda it: _moments(it, p, mean, scale, "x", "y"),
                                "cls double, n long, s array<double>, g array<double>")
        # sum per class over partitions: sums of exploded slots (partial aggregation);
        # slot 0 is the row count, then p sums and the p x p Gram matrix
        slots = F.concat(F.array(F.col("n").cast("double")), F.col("s"), F.col("g"))
        vals = (parts.select("cls", F.posexplode(slots).alias("i", "v"))
                .groupBy("cls", "i").agg(F.sum("v").alias("v")).collect())  # bounded: classes x (1 + p + p^2)
        classes = sorted({r["cls"] for r in vals})
        cidx = {c: j for j, c in enumerate(classes)}
        K = len(classes)
        M = np.zeros((K, 1 + p + p * p))
        for r in vals:
            M[cidx[r["cls"]], r["i"]] = r["v"]
        counts, S, G = M[:, 0], M[:, 1:p + 1], M[:, p + 1:].reshape(K, p, p)
        n = counts.sum()
        mu = S / counts[:, None]
        Sw = sum(G[j] - counts[j] * np.outer(mu[j], mu[j]) for j in range(K))
        cov = Sw / max(n - K, 1)
        evals, evecs = np.linalg.eigh(cov)
        keep = evals > self.getOrDefault(self.tol) * evals.max()
        inv = (evecs[:, keep] / evals[keep]) @ evecs[:, keep].T
        priors = counts / n
        W = inv @ mu.T                                           # p x K
        b = -0.5 * np.einsum("kp,pk->k", mu, W) + np.log(priors)
        gm = priors @ mu
        Sb = sum(counts[j] * np.outer(mu[j] - gm, mu[j] - gm) for j in range(K)) / n
        ev = np.sort(np.real(np.linalg.eigvals(inv @ Sb)))[::-1][:max(K - 1, 1)]
        ev = np.clip(ev, 0, None)
        ratio = (ev / ev.sum()).tolist() if ev.sum() > 0 else ev.tolist()
        # express on the original feature scale: x_std = (x - mean) / scale
        Wo = W / scale[:, None]
        bo = b - (mean / scale) @ W
        m = DiscriminantAnalysisModel(classes=[float(c) for c in classes], coef=Wo.T.tolist(),
                                      intercept=bo.tolist(), explained_variance_ratio=ratio,
                                      means=(mu * scale + mean).tolist())
        return self._copyValues(m)


def _scored(coef: list, intercept: list, classes: list):
    """Scores, probabilities, class of every row. Products are added feature by feature, so that a
    row's numbers do not depend on its batch."""
    def run(x: pa.Array) -> pa.Array:
        import pyarrow as pa
        rows, k = matrix(x), len(classes)
        raw = np.zeros((k, len(rows)))
        for j, w in enumerate(np.array(coef).T):
            raw += w[:, None] * (rows[:, j] if j < rows.shape[1] else np.nan)
        raw += np.array(intercept)[:, None]
        prob, total = np.exp(raw - raw.max(axis=0)), np.zeros(len(rows))
        for c in range(k):
            total += prob[c]
        out = np.vstack([raw, prob / total, np.array(classes)[raw.argmax(axis=0)][None]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (2 * k + 1)), pa.array(out.T.ravel()))
    return run


class DiscriminantAnalysisModel(Model, _LDAParams, SavedState):
    def __init__(self, classes=None, coef=None, intercept=None, explained_variance_ratio=None, means=None):
        super().__init__()
        self.classes = classes or []
        self.coef = coef or []              # K x p
        self.intercept = intercept or []    # K
        self.explained_variance_ratio = explained_variance_ratio or []
        self.means = means or []

    def _state(self) -> dict:
        return {k: getattr(self, k) for k in ("classes", "coef", "intercept", "explained_variance_ratio", "means")}

    @classmethod
    def _from_state(cls, state: dict, path: str) -> DiscriminantAnalysisModel:
        return cls(**state)

    def binary_coefficients(self):
        """Two-class form: w = coef[1] - coef[0], b = intercept[1] - intercept[0]."""
        w = (np.array(self.coef[1]) - np.array(self.coef[0])).tolist()
        return w, self.intercept[1] - self.intercept[0]

    def _transform(self, df: DataFrame) -> DataFrame:
        # scores, probabilities and the prediction of a row in one array: the features are read once a row
        out = arrow_udf(_scored(self.coef, self.intercept, self.classes), "array<double>")
        K = len(self.classes)
        return df.withColumn("_lda", out(vector_to_array(F.col(self.getFeaturesCol())))).withColumns({
            self.getOrDefault(self.rawPredictionCol): array_to_vector(F.slice("_lda", 1, K)),
            self.getOrDefault(self.probabilityCol): array_to_vector(F.slice("_lda", K + 1, K)),
            self.getPredictionCol(): F.get("_lda", F.lit(2 * K))}).drop("_lda")

    def coefficients_table(self, names: list) -> DataFrame:
        """SRT-6 input: (feature, coef) of the two-class discriminant."""
        from pyspark.sql import SparkSession
        w, _ = self.binary_coefficients() if len(self.coef) == 2 else (self.coef[0], 0)
        return SparkSession.getActiveSession().createDataFrame(
            list(zip(names, [float(v) for v in w])), "feature string, coef double")
