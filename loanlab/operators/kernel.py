"""MOD-7: the Gaussian kernel machine at scale, by random Fourier features.

exp(-gamma |a - b|^2) is the mean of cos(v(a - b)) over normal directions v with
variance 2 gamma. ``FourierFeatures`` maps a row to cosines of its products with
such directions, whose dot products come near the kernel (error about
1/sqrt(components)); a linear margin learner on them is the kernel machine, with
work in proportion to the rows and no row x row matrix. The directions follow
from the seed, so they are drawn again where they are needed and never sent.

The features of a row are far wider than the row. ``LinearSVC`` here fits without ever
holding them: every pass makes them anew, a block of rows at a time, in the task that
sums the gradient. Spark's own learner keeps all of them, in memory and then on disk.
"""

from __future__ import annotations

import math
import sys
import uuid

from pyspark import cloudpickle, keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.classification import LinearSVC as SparkLinearSVC, LinearSVCModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .forest import matrix

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BYTES = 64 << 20
BLOCK_ROWS = 1 << 12
STEPS = tuple(0.5 ** i for i in range(-1, 9))
MEMORY = 10


def directions(p: int, components: int, gamma: float, seed: int):
    """(p x components directions, offsets) of the seed; gamma 0 means 1 / p."""
    import numpy as np
    draw = np.random.Generator(np.random.Philox(key=seed))
    v = draw.standard_normal((p, components)) * math.sqrt(2.0 * (gamma or 1.0 / max(p, 1)))
    return v, draw.uniform(0.0, 2 * math.pi, components)


def _cosines(components: int, gamma: float, seed: int):
    def run(x):
        import numpy as np
        import pyarrow as pa
        out, given = [None] * len(x), np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        if len(given):
            flat = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(len(given), -1)
            v, offset = directions(flat.shape[1], components, gamma, seed)
            for at, row in zip(given.tolist(), np.cos(flat @ v + offset) * math.sqrt(2.0 / components), strict=True):
                out[at] = row
        return pa.array(out, pa.list_(pa.float64()))
    return run


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """``outputCol``: random Fourier features of the vector ``inputCol`` (NULL stays NULL). ``gamma`` 0 is
    1 / number of features, the usual choice for standardised ones."""
    components = Param(Params._dummy(), "components", "features made", typeConverter=TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol="features", outputCol="fourier", components=256, gamma=0.0, seed=0):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", components=256, gamma=0.0, seed=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cosines = F.arrow_udf(_typed(_cosines(self.getOrDefault(self.components), self.getOrDefault(self.gamma),
                                              self.getSeed())), "array<double>")
        x = F.col(self.getInputCol())
        out = df.withColumn("_cosines", cosines(F.when(x.isNotNull(), vector_to_array(x))))
        made = F.when(F.col("_cosines").isNotNull(), array_to_vector("_cosines"))
        return out.withColumn(self.getOutputCol(), made).drop("_cosines")


def _typed(run):
    import pyarrow as pa

    def f(x: pa.Array) -> pa.Array:
        return run(x)
    f.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return f


def _blocks(batches):
    """Records of some ``BLOCK_ROWS`` rows of one task: n, the vectors (feature by feature), signs of the labels, weights."""
    import numpy as np
    import pyarrow as pa
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x, y = part.column("x"), part.column("y")
            if x.null_count or y.null_count or part.column("w").null_count or not np.isin(y.to_numpy(), (0.0, 1.0)).all():
                raise ValueError("a row without features or weight, or with a label other than 0 and 1, cannot be fitted")
            cols = (matrix(x).T.astype(np.float32), np.where(y.to_numpy() > 0, 1, -1).astype(np.int8), part.column("w").to_numpy())
            yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int64()), **{
                c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in zip("xyw", cols, strict=True)}})


def _sums(wide: tuple | None, points):
    """A task's sums: weight, by feature x and x * x; and for each of ``points`` (coefficients, intercept last) the hinge loss, the
    signs of the rows inside the margin and these by feature."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        made, total = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column("n")[i].as_py()
                x = np.frombuffer(batch.column("x")[i].as_buffer(), np.float32).reshape(-1, n).T
                y = np.frombuffer(batch.column("y")[i].as_buffer(), np.int8).astype(np.float64)
                w = np.frombuffer(batch.column("w")[i].as_buffer(), np.float64)
                if wide:
                    if made is None:
                        v, offset = directions(x.shape[1], *wide)
                        made = v.astype(np.float32), offset.astype(np.float32), np.float32(math.sqrt(2.0 / wide[0]))
                    x = x @ made[0]
                    x += made[1]
                    np.cos(x, out=x)
                    x *= made[2]
                if points is None:
                    one = np.concatenate([[w.sum()], w @ x, w @ np.square(x, dtype=np.float64)])
                else:
                    short = 1.0 - y[:, None] * (x @ points[:, :-1].T.astype(np.float32) + points[:, -1])
                    pull = np.where(short > 0, -y[:, None], 0.0) * w[:, None]
                    one = np.concatenate([w @ np.maximum(short, 0.0), pull.sum(axis=0), (pull.T.astype(np.float32) @ x).astype(np.float64).ravel()])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total], pa.list_(pa.float64()))})
    return run


class LinearSVC(SparkLinearSVC):
    """Spark's objective (mean hinge loss plus ``regParam`` / 2 times the squared coefficients of standardised features) by
    L-BFGS in passes that hold a block of rows. ``wide``: the ``FourierFeatures`` that made the features, which
    are then made from its input. A pass looks at all ``STEPS`` along a direction."""
    wide: FourierFeatures | None = None

    def _fit(self, dataset: DataFrame) -> LinearSVCModel:
        import numpy as np
        spark, wide = dataset.sparkSession, self.wide
        w = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(vector_to_array(wide.getInputCol() if wide else self.getFeaturesCol()).alias("x"),
                              F.col(self.getLabelCol()).cast("double").alias("y"), w.alias("w"))
        path = scratch_path(spark, f"kernel-{uuid.uuid4().hex}")
        rows.mapInArrow(_blocks, "n long, x binary, y binary, w binary").write.parquet(path)
        blocks = spark.read.schema("n long, x binary, y binary, w binary").parquet(path)
        made = (wide.getOrDefault(wide.components), wide.getOrDefault(wide.gamma), wide.getSeed()) if wide else None

        def summed(points):
            with _small_batches(spark):
                return np.sum([r.sums for r in blocks.mapInArrow(_sums(made, points), "sums array<double>").collect()], axis=0)
        first = summed(None)
        n, d = first[0], (len(first) - 1) // 2
        mean = first[1:d + 1] / n
        var = np.maximum(first[d + 1:] / n - mean * mean, 0.0) * n / max(n - 1.0, 1.0)
        scale = np.where(var > 1e-12 * (mean * mean + var), 1.0 / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)
        if not self.getStandardization():
            raise ValueError("only fitted with standardised features")
        mean, use = (mean, 1.0) if self.getFitIntercept() else (np.zeros(d), 0.0)

        def values(points):
            """(loss, gradient) at each of the points (standardised coefficients, intercept last)."""
            raw = points[:, :-1] * scale
            t = len(points)
            got = summed(np.column_stack([raw, points[:, -1] - raw @ mean]))
            loss, pull, by = got[:t] / n, got[t:2 * t] / n, got[2 * t:].reshape(t, d) / n
            reg = self.getRegParam()
            return loss + reg / 2 * (points[:, :-1] ** 2).sum(axis=1), np.column_stack([
                (by - pull[:, None] * mean) * scale + reg * points[:, :-1], use * pull])
        at = np.zeros(d + 1)
        (f,), (g,) = values(at[None])
        past: list = []
        for _ in range(self.getMaxIter()):
            step = _direction(g, past)
            if not past:
                step = step / max(np.linalg.norm(g), 1e-300)
            points = at + np.outer(STEPS, step)
            fs, gs = values(points)
            best = int(np.argmin(fs))
            if not fs[best] < f + 1e-4 * STEPS[best] * (g @ step):
                if not past:
                    break
                past = []  # once more, straight down
                continue
            moved, turned, gained = points[best] - at, gs[best] - g, f - fs[best]
            at, f, g = points[best], fs[best], gs[best]
            if moved @ turned > 1e-12 * (turned @ turned):
                past = [*past[1 - MEMORY:], (moved, turned)]
            if gained <= self.getTol() * max(abs(f), abs(f + gained), 1e-300):
                break
        raw = at[:-1] * scale
        jvm = spark.sparkContext._jvm
        vector = jvm.org.apache.spark.ml.linalg.Vectors.dense(_java_doubles(spark, raw))
        java = jvm.org.apache.spark.ml.classification.LinearSVCModel(self.uid, vector, float(at[-1] - raw @ mean))
        return self._copyValues(LinearSVCModel(java))


def _java_doubles(spark, values):
    gateway = spark.sparkContext._gateway
    out = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def _direction(g, past: list):
    """The L-BFGS direction of descent."""
    q, alphas = -g, []
    for moved, turned in reversed(past):
        alphas.append((moved @ q) / (moved @ turned))
        q = q - alphas[-1] * turned
    if past:
        moved, turned = past[-1]
        q = q * ((moved @ turned) / (turned @ turned))
    for (moved, turned), a in zip(past, reversed(alphas), strict=True):
        q = q + moved * (a - (turned @ q) / (moved @ turned))
    return q


class _small_batches:
    """Some MB of records a batch for Python while blocks are read."""
    NAME = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.NAME)
        self.conf.set(self.NAME, str(4 << 20))

    def __exit__(self, *_):
        self.conf.set(self.NAME, self.before)


def dealt(df: DataFrame, components: int) -> DataFrame:
    """The rows in so many partitions that the features made from one come to ``PART_BYTES`` at most."""
    parts = math.ceil(df.count() * components * 8.0 / PART_BYTES)
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


class _KernelPipeline(Pipeline):
    """Deals the rows before the fit: the wide features of a partition are far larger than the rows they are made from."""

    def _fit(self, dataset: DataFrame):
        wide = [s for s in self.getStages() if isinstance(s, FourierFeatures)]
        return super()._fit(dealt(dataset, wide[0].getOrDefault(wide[0].components)) if wide else dataset)


def kernel_svm(components: int = 256, gamma: float = 0.0, reg: float = 1e-4, max_iter: int = 50, seed: int = 0,
               label: str = "label", features: str = "features") -> Pipeline:
    """MOD-7: large-margin classifier with a Gaussian kernel; decision score = rawPrediction[1]."""
    made = FourierFeatures(inputCol="_scaled", outputCol="_fourier", components=components, gamma=gamma, seed=seed)
    learner = LinearSVC(regParam=reg, maxIter=max_iter, featuresCol="_fourier", labelCol=label)
    learner.wide = made
    return _KernelPipeline(stages=[StandardScaler(inputCol=features, outputCol="_scaled", withMean=True, withStd=True), made, learner])
