"""MOD-3: AdaBoost (discrete SAMME) over weighted decision stumps.

Features are binned once. All stumps of a round are one table of class weights
by (feature, bin), a single weighted aggregation over the binned rows; the best
Gini split and its weighted error are read off this table, so a round is one
pass. A row's weight is never stored: it follows from the stumps so far, which
go to the tasks as numbers. The model scores Arrow batches, a comparison of a column a stump.

Class probabilities follow the usual SAMME rule: the stumps' leaf class
distributions averaged with the round weights, then a softmax with
temperature 1/(K-1).
"""

from __future__ import annotations

import math
import sys

import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import forest as FO
from .forest import chunks_of, matrix
from ._persist import SavedState

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Stump(Model, HasFeaturesCol, HasPredictionCol):
    """Class shares on both sides of ``features[feature] <= threshold`` (feature -1: no split, the left side)."""

    def __init__(self, feature=-1, threshold=0.0, left=(), right=()):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self.feature, self.threshold, self.left, self.right = feature, threshold, list(left), list(right)

    def setFeaturesCol(self, value):
        return self._set(featuresCol=value)

    def setPredictionCol(self, value):
        return self._set(predictionCol=value)

    def predict(self, features) -> float:
        side = self.left if self.feature < 0 or features[self.feature] <= self.threshold else self.right
        return float(side.index(max(side)))

    def _transform(self, df: DataFrame) -> DataFrame:
        x, classes = F.get(vector_to_array(self.getFeaturesCol()), F.lit(max(self.feature, 0))), []
        for side in (self.left, self.right):
            classes.append(F.lit(float(side.index(max(side)))))
        return df.withColumn(self.getPredictionCol(), F.when(
            F.lit(self.feature < 0) | (x <= F.lit(self.threshold)), classes[0]).otherwise(classes[1]))


class _AdaParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasSeed):
    learningRate = Param(Params._dummy(), "learningRate", "shrinkage of the round weights",
                         typeConverter=TypeConverters.toFloat)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "rounds between checkpoints",
                               typeConverter=TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of the stump thresholds", typeConverter=TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         maxIter=50, learningRate=1.0, checkpointInterval=5, maxBins=64, seed=123)


class AdaBoost(Estimator, _AdaParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 maxIter=50, learningRate=1.0, checkpointInterval=5, maxBins=64, seed=123):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        feat, label = self.getFeaturesCol(), self.getLabelCol()
        data = df.select(F.monotonically_increasing_id().alias("id"), F.col(feat).alias("features"),
                         F.col(label).cast("double").alias("label"))
        K = max(2, len(data.select("label").distinct().collect()))  # number of classes (bounded)
        bounds = FO.feature_bounds(data, max_bins=self.getOrDefault(self.maxBins), middle=True)
        rows = FO._stored(FO.blocks(FO._spread(FO.binned(data, bounds).select("y", "w", "bins")), len(bounds)), "ada")
        lr = self.getOrDefault(self.learningRate)
        stumps, alphas, past = [], [], []  # past: (feature, bin, left class, right class, weight, log of the weights' sum)
        for _ in range(self.getMaxIter()):
            with FO.small_batches(df.sparkSession):
                table = _class_weights(rows, past, FO.Histogram(bounds, max(map(len, bounds), default=0) + 1), K)
            feature, cut, left, right = _best_stump(table)
            total = float(left.sum() + right.sum())
            err = float(total - left.max() - right.max()) / total
            stump = Stump(feature, bounds[feature][cut] if feature >= 0 else 0.0, (left / left.sum()).tolist(),
                          (right / right.sum()).tolist() if feature >= 0 else [])
            if feature < 0:
                stump.right = stump.left
            if err <= 0:
                stumps.append(stump)
                alphas.append(1.0)
                break
            if err >= 1 - 1.0 / K:
                if not stumps:
                    raise ValueError("first stump no better than chance")
                break
            alpha = lr * (math.log((1 - err) / err) + math.log(K - 1))
            stumps.append(stump)
            alphas.append(alpha)
            past.append((feature, cut, int(left.argmax()), int(right.argmax()), alpha,
                         math.log(total) + math.log1p(err * math.expm1(alpha))))
        return self._copyValues(AdaBoostModel(stumps=stumps, alphas=alphas, num_classes=K))


def _class_weights(rows: DataFrame, past: list, hist: FO.Histogram, k: int):
    """Class weights (p x n_bins x k) of all rows by feature and bin, weights as the stumps so far make them."""
    import numpy as np
    p, n_bins = hist.p, hist.n_bins

    def run(batches):
        import pyarrow as pa
        sums = np.zeros((k, p * n_bins))
        for _, _, cols, bins in chunks_of(batches, p):
            y, log_w = cols["y"], np.zeros(bins.shape[1])
            for feature, cut, left, right, alpha, norm in past:
                said = np.where(bins[feature] <= cut, left, right) if feature >= 0 else np.full(len(y), left)
                log_w += alpha * (said != y)
                log_w -= norm
            sums += hist.add(y.astype(np.int64), k, bins, [np.exp(log_w)]).reshape(k, p * n_bins)
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()),
                                          **{f"c{c}": pa.array(sums[c][at]) for c in range(k)}})
    schema = "at long, " + ", ".join(f"c{c} double" for c in range(k))
    found = rows.mapInArrow(run, schema).groupBy("at").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in range(k)])
    got = found.toArrow()  # a row a feature and bin
    table = np.zeros((p * n_bins, k))
    for c in range(k):
        table[got.column("at").to_numpy(), c] = got.column(f"c{c}").to_numpy()
    return table.reshape(p, n_bins, k)


def _best_stump(table):
    """(feature, bin, left class weights, right ones) of the best Gini split; ties to the first
    feature and bin; feature -1 and all weights on the left where no split separates anything."""
    import numpy as np
    left = table.cumsum(axis=1)
    right = left[:, -1:, :] - left
    whole = left[0, -1] if len(left) else np.ones(1)
    n_left, n_right = left.sum(axis=2), right.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left ** 2).sum(axis=2) / n_left + (right ** 2).sum(axis=2) / n_right
    tiny = 1e-12 * whole.sum()  # what rounding leaves of an empty side
    gain = np.where((n_left > tiny) & (n_right > tiny), gain, -np.inf)
    best = gain.max() if gain.size else -np.inf
    if not best > (whole ** 2).sum() / whole.sum() * (1 + 1e-12):
        return -1, -1, whole, np.zeros_like(whole)
    at = int(np.argmax(gain >= best * (1 - 1e-12)))  # splits that rounding alone tells apart are ties
    f, b = at // gain.shape[1], at % gain.shape[1]
    return f, b, left[f, b], np.maximum(right[f, b], 0)


class AdaBoostModel(Model, _AdaParams, SavedState):
    def __init__(self, stumps=None, alphas=None, num_classes=2):
        super().__init__()
        self.stumps = stumps or []
        self.alphas = alphas or []
        self.num_classes = num_classes

    def _state(self) -> dict:
        return {"alphas": [float(a) for a in self.alphas], "num_classes": self.num_classes,
                "stumps": [[s.feature, s.threshold, s.left, s.right] for s in self.stumps]}

    @classmethod
    def _from_state(cls, state: dict, path: str) -> AdaBoostModel:
        return cls([Stump(*s) for s in state["stumps"]], state["alphas"], state["num_classes"])

    def _transform(self, df: DataFrame) -> DataFrame:
        # probabilities and the prediction of a row in one array: the features reach the stumps once a row
        stumps = [(s.feature, s.threshold, s.left, s.right) for s in self.stumps]
        out = arrow_udf(_voted(stumps, self.alphas, self.num_classes), "array<double>")
        K = self.num_classes
        return df.withColumn("_ada", out(vector_to_array(self.getFeaturesCol()))).withColumns({
            "probability": array_to_vector(F.slice("_ada", 1, K)), self.getPredictionCol(): F.get("_ada", F.lit(K))}).drop("_ada")


def _voted(stumps: list, alphas: list, k: int):
    """Probabilities, then the label, of every row. The label is the weighted vote of the stumps, ties to the smaller class."""
    def run(x: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        rows = matrix(x)
        shares, tally = np.zeros((k, len(rows))), np.zeros((k, len(rows)))
        for (feature, threshold, *sides), a in zip(stumps, alphas, strict=True):
            go = rows[:, feature] <= threshold if 0 <= feature < rows.shape[1] else np.full(len(rows), feature < 0)
            best = [side.index(max(side)) for side in sides]
            for c in range(k):
                shares[c] += np.where(go, a * sides[0][c], a * sides[1][c])
                tally[c] += np.where(go, *(a if c == b else 0.0 for b in best))
        shares = np.exp(shares / float(sum(alphas)) / float(k - 1))
        total = np.zeros(len(rows))
        for c in range(k):
            total += shares[c]
        out = np.vstack([shares / total, tally.argmax(axis=0)[None]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (k + 1)), pa.array(out.T.ravel()))
    return run
