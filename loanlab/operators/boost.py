"""MOD-8: gradient-boosted trees with second-order leaves (logistic loss).

Features are binned once. A row's gradient is p - y and its Hessian p(1 - p),
both times its weight. Trees grow level by level: tasks sum gradients and
Hessians of all open nodes by (node, feature, bin), Spark adds them up as one
vector a node, and each node's best split is read off the cumulative sums, as
are the sums of both its children: a tree of depth d is d passes with one
exchange each, and its leaves need none of their own. The driver receives one
vector of 2 x features x bins numbers per open node. A leaf is -G / (H + lambda); a split must raise
G^2 / (H + lambda) by more than ``2 * gamma`` and leave ``minHessian`` on both
sides.

A row's margin is the sum of its leaves so far. Tasks walk the trees since the
margins were last written (every ``checkpointInterval`` rounds, to the shared
folder), so a pass does not grow with the rounds. Rows are kept in blocks of byte
columns (``forest.blocks``): a walk combines masks of whole columns, and an
indicator feature costs only the rows that have it. The model is a list of small
trees, walked by Arrow batches.

NULL labels, NULL features and NULL or negative weights are refused, as is an
empty table; NaN goes right at every split. With one class the model is
the margin of its share, held off infinity by half a row.
"""

from __future__ import annotations

import math
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol,
                                     HasRawPredictionCol, Param, Params, TypeConverters)
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ..session import scratch_path
from . import forest as FO
from .forest import chunks_of, matrix
from ._persist import SavedState

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits of a tree", typeConverter=TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage of the leaves", typeConverter=TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "L2 weight of the leaves", typeConverter=TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "least gain of a split", typeConverter=TypeConverters.toFloat)
    minHessian = Param(Params._dummy(), "minHessian", "least Hessian of a side", typeConverter=TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", typeConverter=TypeConverters.toInt)
    checkpointInterval = Param(Params._dummy(), "checkpointInterval", "rounds between written margins",
                               typeConverter=TypeConverters.toInt)
    weightCol = Param(Params._dummy(), "weightCol", "row weights; empty: all 1", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                         rawPredictionCol="rawPrediction", maxIter=100, maxDepth=4, stepSize=0.1, regLambda=1.0, gamma=0.0,
                         minHessian=1.0, maxBins=64, checkpointInterval=10, weightCol="")


def _nodes_of(tree: dict, bins):
    """Node of every row of ``bins`` (features x rows): ``tree`` maps an inner node to (feature, bin).
    Masks of bytes are combined, which costs a fraction of a nanosecond a row and node."""
    import numpy as np
    at = np.zeros(bins.shape[1], np.uint8 if max(tree, default=0) < 127 else np.int64)
    reach = {0: np.ones(bins.shape[1], bool)}
    for node in sorted(tree):
        feature, cut = tree[node]
        here, right = reach.pop(node), bins[feature] > cut
        reach[2 * node + 1], reach[2 * node + 2] = here & ~right, here & right
    for node, mask in reach.items():
        if node:
            at += mask.astype(at.dtype) * at.dtype.type(node)
    return at


def _margins(written, bins, done: list):
    """Margins of the rows: those written plus the leaves of the trees since."""
    import numpy as np
    m = written.copy()
    for tree, leaves in done:
        value = np.zeros(max(leaves) + 1)
        for node, v in leaves.items():
            value[node] = v
        m += value[_nodes_of(tree, bins)]
    return m


def _sums(done: list, tree: dict, opened: list, hist: FO.Histogram, pull):
    """(node, sums): of the open nodes over a task's rows, gradients then Hessians by feature and bin."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        out = 0
        slots = np.full(2 * max(opened) + 3 if not tree else 2 * max(max(tree), max(opened)) + 3, len(opened), np.int64)
        slots[opened] = np.arange(len(opened))
        for _, _, cols, bins in chunks_of(batches, hist.p, ("margin",)):
            at = slots[_nodes_of(tree, bins)]
            out = out + hist.add(at, len(opened), bins, pull(_margins(cols["margin"], bins, done), cols["y"], cols["w"]))
        if not np.isscalar(out):
            yield pa.RecordBatch.from_pydict({"node": pa.array(opened, pa.int64()), "sums": pa.array(
                [v.ravel() for v in out], pa.list_(pa.float64()))})
    return run


def _logistic(m, y, w):
    """Gradients and Hessians of the logistic loss."""
    import numpy as np
    prob = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
    return [(prob - y) * w, prob * (1 - prob) * w]


def _labels(m, y, w):
    """What a first tree is fitted to: labels of -1 and 1."""
    return [(1.0 - 2.0 * y) * w, w]


def _residuals(m, y, w):
    """Negative residuals of the loss 2 log(1 + exp(-2 s m)), s a label of -1 or 1, and the rows' weights."""
    import numpy as np
    s = 2.0 * y - 1.0
    return [-4.0 * s / (1.0 + np.exp(np.clip(2.0 * s * m, -700, 700))) * w, w]


def _moved(done: list, p: int):
    """The row table with its margins brought up to date."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for part, n, cols, bins in chunks_of(batches, p, ("margin",)):
            m, ends = _margins(cols["margin"], bins, done), np.cumsum([0, *n])
            yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("n", "y", "w", "bins")}, "margin": pa.array(
                [m[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())}).select(part.schema.names)
    return run


def _best(sums, reg: float, least: float):
    """(G, H, gain, feature, bin, left G, left H) of a node's best split of ``sums`` (2 x features x bins);
    gain None where no split leaves ``least`` Hessian on both sides; ties to the first feature and bin."""
    import numpy as np
    (gl, hl), (g, h) = sums.cumsum(axis=2), sums[:, 0].sum(axis=1)

    def worth(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(b + reg > 0, a * a / (b + reg), 0.0)
    gain = np.where((hl >= least) & (h - hl >= least), worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), -np.inf)
    gain[:, -1] = -np.inf  # all on the left
    best = gain.max()
    if best == -np.inf:
        return g, h, None, -1, -1, 0.0, 0.0
    at = int(np.argmax(gain >= best - 1e-12 * abs(best)))  # splits that rounding alone tells apart are ties
    f, b = at // gain.shape[1], at % gain.shape[1]
    return g, h, float(gain[f, b]), f, b, gl[f, b], hl[f, b]


class NewtonBoost(Estimator, _BoostParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees of a 0/1 label."""

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 rawPredictionCol="rawPrediction", maxIter=100, maxDepth=4, stepSize=0.1, regLambda=1.0, gamma=0.0,
                 minHessian=1.0, maxBins=64, checkpointInterval=10, weightCol=""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        spark, get = df.sparkSession, self.getOrDefault
        label, weight = F.col(self.getLabelCol()).cast("double"), get(self.weightCol)
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        data = df.select(F.monotonically_increasing_id().alias("id"), F.col(self.getFeaturesCol()).alias("features"),
                         label.alias("label"), w.alias("w"))
        bad = F.col("features").isNull() | F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0) | F.col(
            "w").isNull() | (F.col("w") < 0) | F.isnan("w")
        seen = data.agg(F.count_if(bad).alias("bad"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("pos")).first()
        if seen["bad"]:
            raise ValueError("a row without features, a 0/1 label or a usable weight cannot be fitted")
        if not seen["n"]:
            raise ValueError("no row to fit")
        bounds = FO.feature_bounds(data, max_bins=get(self.maxBins), middle=True)
        hist = FO.Histogram(bounds, max(map(len, bounds), default=0) + 1)
        start = self._start(seen["n"], seen["pos"])
        rows = FO.binned(data, bounds, weight="w").select("y", "w", "bins").withColumn("margin", F.lit(start))
        rows = FO._stored(FO.blocks(FO._spread(rows), len(bounds), ("margin",)), "boost")
        trees, since = [], []
        with FO.small_batches(spark):
            for _ in range(get(self.maxIter)):
                if len(since) == get(self.checkpointInterval):
                    path = scratch_path(spark, f"boost-{uuid.uuid4().hex}")
                    rows.mapInArrow(_moved(since, len(bounds)), rows.schema).write.parquet(path)
                    rows, since = spark.read.schema(rows.schema).parquet(path), []
                tree, leaves, gains = self._tree(rows, since, hist, not trees)
                if not tree and abs(leaves.get(0, 0.0)) < 1e-12:
                    break  # nothing left to learn
                since.append((tree, leaves))
                trees.append([[n, f, bounds[f][b], gains[n]] for n, (f, b) in tree.items()]
                             + [[n, -1, 0.0, v] for n, v in leaves.items()])
        return self._copyValues(NewtonBoostModel(start, trees, self.slope, len(bounds)))

    slope = 1.0  # of the margin in the log odds

    def _start(self, n: float, pos: float) -> float:
        return math.log((pos + 0.5) / (n - pos + 0.5))

    def _round(self, first: bool):
        """(gradients and Hessians, shrinkage) of a round."""
        return _logistic, self.getOrDefault(self.stepSize)

    def _tree(self, rows: DataFrame, since: list, hist: FO.Histogram, first: bool):
        """({inner node: (feature, bin)}, {leaf: value}, {inner node: gain}) of the next round."""
        get = self.getOrDefault
        reg, least, gamma = get(self.regLambda), get(self.minHessian), get(self.gamma)
        tree, leaves, gains, opened = {}, {}, {}, [0]
        pull, step = self._round(first)

        def value(g, h):
            return -step * g / (h + reg) if h + reg > 0 else 0.0
        for depth in range(get(self.maxDepth)):
            found = rows.mapInArrow(_sums(since, tree, opened, hist, pull), "node long, sums array<double>")
            found = found.groupBy("node").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
            below = []
            for r in sorted(found.collect(), key=lambda r: r["node"]):  # a row an open node: at most 2^depth of 2 x features x bins numbers
                g, h, gain, f, b, gl, hl = _best(r["sums"].toArray().reshape(2, hist.p, hist.n_bins), reg, least)
                if gain is None or not gain > 2 * gamma + 1e-12:
                    leaves[r["node"]] = float(value(g, h))
                    continue
                tree[r["node"]], gains[r["node"]] = (int(f), int(b)), gain
                for child, a, c in ((2 * r["node"] + 1, gl, hl), (2 * r["node"] + 2, g - gl, h - hl)):
                    leaves[child] = float(value(a, c))
                    below.append(child)
            opened = below
            if not opened:
                break
        return tree, {n: v for n, v in leaves.items() if n not in tree}, gains


class FirstOrderBoost(NewtonBoost):
    """Boosted regression trees of Friedman's logistic loss, as Spark's ``GBTClassifier``: the first
    tree is fitted to labels of -1 and 1 and counts whole, each further one to the residuals, by
    variance; a leaf is the mean of its rows."""

    slope = 2.0

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 rawPredictionCol="rawPrediction", maxIter=20, maxDepth=5, stepSize=0.1, regLambda=0.0, gamma=0.0,
                 minHessian=1.0, maxBins=64, checkpointInterval=10, weightCol=""):
        kwargs = self._input_kwargs
        super().__init__(**{"maxIter": 20, "maxDepth": 5, "regLambda": 0.0, **kwargs})

    def _start(self, n: float, pos: float) -> float:
        return 0.0

    def _round(self, first: bool):
        return (_labels, 1.0) if first else (_residuals, self.getOrDefault(self.stepSize))


class NewtonBoostModel(Model, _BoostParams, SavedState):
    """``start`` margin and ``trees``: per tree [node, feature, threshold, value], leaves with feature -1;
    the value of an inner node is its gain."""

    def __init__(self, start=0.0, trees=None, slope=1.0, features=0):
        super().__init__()
        self.start, self.trees, self.slope, self.features = start, trees or [], slope, features

    def _state(self) -> dict:
        return {"start": self.start, "trees": self.trees, "slope": self.slope, "features": self.features}

    @property
    def featureImportances(self):
        """Share of each feature in the gains of all splits."""
        gains = [0.0] * self.features
        for _, f, _, gain in (n for t in self.trees for n in t if n[1] >= 0):
            gains[f] += gain
        return Vectors.dense([g / (sum(gains) or 1.0) for g in gains])

    @classmethod
    def _from_state(cls, state: dict, path: str) -> NewtonBoostModel:
        return cls(**state)

    def _transform(self, df: DataFrame) -> DataFrame:
        # the margin in Arrow batches: in a column expression every node of a path would read the vector anew
        margin = arrow_udf(_walked(self.start, self.trees), "double")
        out = df.withColumn("_boost_m", margin(vector_to_array(self.getFeaturesCol())))
        m = F.col("_boost_m")
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(-m if self.slope == 1.0 else -m * F.lit(float(self.slope))))
        return out.withColumns({
            self.getRawPredictionCol(): array_to_vector(F.array(-m, m)),
            self.getProbabilityCol(): array_to_vector(F.array(F.lit(1.0) - share, share)),
            self.getPredictionCol(): (m > 0).cast("double")}).drop("_boost_m")


def _walked(start: float, trees: list):
    """Margins of the rows: the leaves of all trees, added in their order."""
    depth = max([(n + 1).bit_length() - 1 for t in trees for n, *_ in t], default=0)
    full = [_complete(t, depth) for t in trees]

    def run(x: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        rows = matrix(x)
        wide = 1 + max((max(t["f"], default=0) for t in full), default=0)
        if rows.shape[1] < wide:
            rows = np.hstack([rows, np.full((len(rows), wide - rows.shape[1]), np.nan)])
        m, every = np.full(len(rows), float(start)), np.arange(len(rows))
        for t in full:
            f, cut, at = np.array(t["f"], np.int64), np.array(t["t"]), np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 2 - (rows[every, f[at]] <= cut[at])
            m += np.array(t["v"])[at - (2 ** depth - 1)]
        return pa.array(m)
    return run


def _complete(tree: list, depth: int) -> dict:
    """Features, thresholds of the inner places and values of the last level of a full binary tree."""
    inner = 2 ** depth - 1
    f, t, v = [0] * inner, [0.0] * inner, [0.0] * (inner + 1)
    for node, feature, threshold, value in tree:
        if feature >= 0:
            f[node], t[node] = feature, threshold
        else:
            first, last = node, node  # all places below a leaf hold its value
            while first < inner:
                first, last = 2 * first + 1, 2 * last + 2
            for i in range(first, last + 1):
                v[i - inner] = value
    return {"f": f, "t": t, "v": v}
