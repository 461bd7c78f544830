"""MOD-5: linear models of any number of classes by averaged local gradient steps.

One weight matrix holds a column a class, each trained one against the rest, so
that all classes learn from one reading of a row. A round is one pass: every
task starts from the common weights, goes through its rows in small batches with
steps scaled by the squares of the gradients so far, and returns its weights;
their average by rows is where the next round starts. Per class a task returns
one row, merged by Spark's vector sums, so that the driver receives a row a
class. The rows are dealt out evenly once, so a table sorted by class does no
harm, and are read back from the shared folder in every round.

Features are standardised with the training rows' mean and population deviation
inside the tasks; the model is stated on the scale of the given features and
scored by one column expression.

Rows whose weight is 0 take no part. A NULL or non-finite feature, a NULL label
and a NULL or negative weight are refused, as is an empty table. With one class
all rows get it.
"""

from __future__ import annotations

import json
import math
import sys
import uuid

import numpy as np
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, HasRegParam, HasSeed, HasTol, Param, Params, TypeConverters)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from ._persist import SavedState

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_ROWS = 8_192      # rows of a task in small tables
PART_BYTES = 128 << 20  # bytes of a task in large ones
SMALL_PARTS = 64


class _SGDParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter,
                 HasRegParam, HasSeed, HasTol):
    loss = Param(Params._dummy(), "loss", "log (logistic) or hinge (large margin)", typeConverter=TypeConverters.toString)
    stepSize = Param(Params._dummy(), "stepSize", "step before scaling", typeConverter=TypeConverters.toFloat)
    batchRows = Param(Params._dummy(), "batchRows", "rows of a gradient step", typeConverter=TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "row weights; empty: all 1", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                         rawPredictionCol="rawPrediction", maxIter=20, regParam=1e-4, seed=0, tol=1e-3, loss="log",
                         stepSize=0.1, batchRows=64, weightCol="")


def _gradient(loss: str, z, target, w):
    """(d loss / d z weighted, summed loss) of scores ``z`` for ``target`` in {-1, 1} (n x k)."""
    m = target * z
    if loss == "hinge":
        return np.where(m < 1, -target, 0.0) * w[:, None], float((np.maximum(0.0, 1 - m) * w[:, None]).sum())
    return -target * w[:, None] / (1 + np.exp(np.minimum(m, 700))), float((np.logaddexp(0, -m) * w[:, None]).sum())


def _local_steps(weights, squares, mean, scale, k: int, loss: str, step: float, reg: float, batch_rows: int, seed: int,
                 round_: int):
    """A task's steps over its rows: (class, n, loss, weights x n, squares x n), a row a class."""
    def run(batches):
        import pyarrow as pa
        own, seen, n, lost = weights.copy(), squares.copy(), 0.0, 0.0
        decay = np.full((len(mean) + 1, 1), reg)
        decay[-1] = 0.0  # the intercept is not shrunk
        for at, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            x = (batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) - mean) / scale
            x = np.hstack([x, np.ones((len(x), 1))])
            y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
            order = np.random.Generator(np.random.Philox(key=[seed, (round_ << 32) + at])).permutation(len(x))
            for first in range(0, len(x), batch_rows):
                rows = order[first:first + batch_rows]
                target = np.where(y[rows, None] == np.arange(k), 1.0, -1.0)
                g, part = _gradient(loss, x[rows] @ own, target, w[rows])
                g = x[rows].T @ g / w[rows].sum() + decay * own
                seen += g * g
                own -= step * g / np.sqrt(seen + 1e-12)
                lost += part
            n += float(w.sum())
        if n:
            yield pa.RecordBatch.from_pydict({
                "k": pa.array(np.arange(k, dtype=np.int32)), "n": pa.array(np.full(k, n)),
                "lost": pa.array(np.full(k, lost)),
                "w": pa.array((own.T * n).tolist(), pa.list_(pa.float64())),
                "g": pa.array((seen.T * n).tolist(), pa.list_(pa.float64()))})
    return run


class AveragedSGD(Estimator, _SGDParams, DefaultParamsReadable, DefaultParamsWritable):
    """One-vs-rest linear classifier (``loss``: log or hinge) by averaged local gradient steps."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 rawPredictionCol="rawPrediction", maxIter=20, regParam=1e-4, seed=0, tol=1e-3, loss="log", stepSize=0.1,
                 batchRows=64, weightCol=""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        spark, loss = df.sparkSession, self.getOrDefault(self.loss)
        if loss not in ("log", "hinge"):
            raise ValueError(f"loss is log or hinge, not {loss}")
        feat, label, weight = F.col(self.getFeaturesCol()), F.col(self.getLabelCol()), self.getOrDefault(self.weightCol)
        x, w = vector_to_array(feat), F.col(weight).cast("double") if weight else F.lit(1.0)
        given = label.cast("double")
        bad = feat.isNull() | given.isNull() | F.isnan(given) | w.isNull() | (w < 0) | F.isnan(w) | F.exists(
            x, lambda v: F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
        rows = df.select(x.alias("x"), given.alias("label"), w.alias("w"), bad.alias("bad"))
        found = rows.agg(F.count_if("bad").alias("bad"), F.count_if(F.col("w") > 0).alias("n")).first()
        if found["bad"]:
            raise ValueError("a row without a label, a usable weight or finite features cannot be fitted")
        n = found["n"]
        if not n:
            raise ValueError("no row to fit")
        rows = rows.where(F.col("w") > 0).drop("bad")
        stats = rows.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector("x")).alias("s")).first()["s"]
        mean, scale = stats["mean"].toArray(), np.sqrt(stats["variance"].toArray() * (n - 1) / n)  # population deviation
        scale[scale == 0] = 1.0
        classes = sorted(r[0] for r in rows.select("label").distinct().collect())  # a row a class
        k, p = len(classes), len(mean)
        y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
        parts = min(math.ceil(n / PART_ROWS), max(SMALL_PARTS, math.ceil(n * 8.0 * p / PART_BYTES)))
        path = scratch_path(spark, f"sgd-{uuid.uuid4().hex}")
        rows.select("x", y.cast("int").alias("y"), "w").repartition(parts).write.parquet(path)
        rows = spark.read.schema("x array<double>, y int, w double").parquet(path)
        weights, squares, last = np.zeros((p + 1, k)), np.zeros((p + 1, k)), math.inf
        for round_ in range(self.getMaxIter()):
            step = _local_steps(weights, squares, mean, scale, k, loss, self.getOrDefault(self.stepSize),
                                self.getRegParam(), self.getOrDefault(self.batchRows), self.getSeed(), round_)
            found = rows.mapInArrow(step, "k int, n double, lost double, w array<double>, g array<double>")
            merged = found.groupBy("k").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"),
                                            Summarizer.sum(array_to_vector("w")).alias("w"),
                                            Summarizer.sum(array_to_vector("g")).alias("g")).collect()  # a row a class
            for r in merged:
                weights[:, r["k"]], squares[:, r["k"]] = r["w"].toArray() / r["n"], r["g"].toArray() / r["n"]
            mean_loss = merged[0]["lost"] / merged[0]["n"]
            if last - mean_loss < self.getTol() * mean_loss:
                break
            last = mean_loss
        coef = weights[:-1] / scale[:, None]
        return self._copyValues(AveragedSGDModel([float(c) for c in classes], coef.T.tolist(),
                                                 (weights[-1] - mean @ coef).tolist(), round_ + 1))


class AveragedSGDModel(Model, _SGDParams, SavedState):
    """``coef`` (a row a class) and ``intercept`` on the scale of the given features; ``rounds`` done."""

    def __init__(self, classes=None, coef=None, intercept=None, rounds=0):
        super().__init__()
        self.classes, self.coef, self.intercept, self.rounds = classes or [], coef or [], intercept or [], rounds

    def _state(self) -> dict:
        return {c: getattr(self, c) for c in ("classes", "coef", "intercept", "rounds")}

    @classmethod
    def _from_state(cls, state: dict, path: str) -> AveragedSGDModel:
        return cls(**state)

    def _transform(self, df: DataFrame) -> DataFrame:
        # one text literal that the optimiser folds into one array, instead of a literal a number
        table = F.from_json(F.lit(json.dumps([{"w": c, "b": b} for c, b in zip(self.coef, self.intercept, strict=True)])),
                            "array<struct<w: array<double>, b: double>>")
        x = vector_to_array(self.getFeaturesCol())
        raw = F.transform(table, lambda c: F.aggregate(F.zip_with(x, c["w"], lambda a, b: a * b), c["b"],
                                                       lambda s, v: s + v))
        out, at = df.withColumn("_sgd_raw", raw), F.col("_sgd_raw")
        names = F.array(*[F.lit(c) for c in self.classes])
        cols = {self.getRawPredictionCol(): array_to_vector(at),
                self.getPredictionCol(): F.element_at(names, F.array_position(at, F.array_max(at)).cast("int"))}
        if self.getOrDefault(self.loss) == "log":  # one-vs-rest shares, scaled to a sum of 1
            share = F.transform(at, lambda v: F.lit(1.0) / (F.lit(1.0) + F.exp(-v)))
            total = F.aggregate(share, F.lit(0.0), lambda s, v: s + v)
            cols[self.getProbabilityCol()] = array_to_vector(F.transform(
                share, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / len(self.classes)))))
        return out.withColumns(cols).drop("_sgd_raw")
