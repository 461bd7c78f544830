"""Second-order boosted trees (MOD-8)."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loanlab.operators import models as M
from loanlab.operators.boost import NewtonBoost


def table(spark, x, y, w=None):
    rows = [(i, [float(v) for v in a], None if b is None else float(b), 1.0 if w is None else w[i])
            for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double, w double").withColumn(
        "features", array_to_vector("x"))


def plain(x, y, w, rounds, depth, step, lam, gamma, least):
    """Margins after the rounds, by exhaustive search over all cuts between values."""
    m = np.full(len(x), math.log(((w * y).sum() + 0.5) / ((w * (1 - y)).sum() + 0.5)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h, new = (p - y) * w, p * (1 - p) * w, m.copy()
        todo = [(np.arange(len(x)), 0)]
        while todo:
            own, level = todo.pop()
            best, G, H = None, g[own].sum(), h[own].sum()
            for f in range(x.shape[1]) if level < depth else ():
                for cut in np.unique(x[:, f])[:-1]:
                    left = own[x[own, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    if len(left) in (0, len(own)) or hl < least or H - hl < least:
                        continue
                    gain = gl ** 2 / (hl + lam) + (G - gl) ** 2 / (H - hl + lam) - G ** 2 / (H + lam)
                    if gain > 2 * gamma + 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut)
            if best is None:
                new[own] = m[own] - step * G / (H + lam)
            else:
                go = x[own, best[1]] <= best[2]
                todo += [(own[go], level + 1), (own[~go], level + 1)]
        m = new
    return m


@pytest.mark.parametrize("depth,lam,gamma,least", [(1, 1.0, 0.0, 1.0), (3, 1.0, 0.0, 1.0), (3, 0.5, 0.3, 0.2)])
def test_equal_to_an_exhaustive_search(spark, depth, lam, gamma, least):
    g = np.random.default_rng(depth)
    x = np.round(g.normal(size=(250, 3)), 1)  # at most 64 values a feature
    y = ((x[:, 0] + x[:, 1] ** 2 + g.normal(0, 0.5, 250)) > 0.8).astype(float)
    w = np.where(g.random(250) < 0.3, 2.0, 1.0)
    est = NewtonBoost(maxIter=5, maxDepth=depth, stepSize=0.3, regLambda=lam, gamma=gamma, minHessian=least,
                      checkpointInterval=2, weightCol="w", maxBins=100)
    df = table(spark, x, y, w.tolist())
    got = est.fit(df.repartition(3)).transform(df).orderBy("id").select(vector_to_array("rawPrediction")[1]).collect()
    assert np.allclose([r[0] for r in got], plain(x, y, w, 5, depth, 0.3, lam, gamma, least), atol=1e-9)


def test_leaves_by_hand(spark):
    """One stump: leaves are -G / (H + lambda)."""
    m = NewtonBoost(maxIter=1, maxDepth=1, stepSize=1.0, regLambda=2.0, minHessian=0.0).fit(
        table(spark, [[0.0], [0.0], [1.0], [1.0]], [0, 0, 1, 1]))
    (tree,) = m.trees
    assert m.start == 0.0
    assert {n: v for n, f, _, v in tree if f < 0} == {1: pytest.approx(-1 / 2.5), 2: pytest.approx(1 / 2.5)}
    assert [t for _, f, t, _ in tree if f == 0] == [0.5]


def test_beats_first_order_saves_and_scores(spark, tmp_path):
    g = np.random.default_rng(9)
    x = g.uniform(-1, 1, (1500, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (g.random(1500) < 0.05)).astype(int)
    df = table(spark, x, y)
    train, test = df.where("id < 1000"), df.where("id >= 1000")
    model = Pipeline(stages=[NewtonBoost(maxIter=20)]).fit(train)
    acc = model.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert acc > 0.85
    model.write().save(str(tmp_path / "m"))
    a, b = (M.score(t, test).orderBy("id").collect() for t in (model, PipelineModel.load(str(tmp_path / "m"))))
    assert a == b and all(0 < r.score < 1 for r in a)


def test_odd_rows(spark):
    one = NewtonBoost(maxIter=3).fit(table(spark, [[1.0], [2.0]], [1, 1]))
    assert [r.prediction for r in one.transform(table(spark, [[5.0]], [0])).collect()] == [1.0]
    flat = NewtonBoost(maxIter=3).fit(table(spark, [[1.0]] * 4, [0, 1, 0, 1]))  # nothing to split on
    assert flat.trees == []
    for bad in (table(spark, [[1.0]], [None]), table(spark, [[1.0]], [2]), table(spark, [[1.0]], [1]).limit(0)):
        with pytest.raises(ValueError):
            NewtonBoost().fit(bad)
    for w in (-1.0, None, math.nan):
        with pytest.raises(ValueError):
            NewtonBoost(weightCol="w").fit(table(spark, [[1.0]], [1], [w]))
