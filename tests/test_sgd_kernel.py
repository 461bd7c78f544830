"""Averaged local gradient steps (MOD-5, FEA-11) and Fourier features of the Gaussian kernel (MOD-7)."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loanlab.operators import kernel as KE, models as M, sgd as SG


def table(spark, x, y, **cols):
    rows = [(int(i), [float(v) for v in a], None if b is None else float(b), *[c[i] for c in cols.values()])
            for i, (a, b) in enumerate(zip(x, y, strict=True))]
    schema = "id long, x array<double>, label double" + "".join(f", {c} double" for c in cols)
    return spark.createDataFrame(rows, schema).withColumn("features", array_to_vector("x"))


def blobs(n=3000, k=4, seed=1):
    g = np.random.default_rng(seed)
    centre, y = g.normal(0, 3, (k, 6)), g.integers(0, k, n)
    x = centre[y] + g.normal(size=(n, 6))
    x[:, 0] = x[:, 0] * 1e6 + 1e9  # as dates are
    return x, y


def accuracy(model, df):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def test_one_step_by_hand(spark):
    """One batch, one pass: weights are minus the scaled first gradient."""
    x, y = np.array([[0.0, 2.0], [2.0, 0.0], [4.0, 4.0], [6.0, 2.0]]), [0, 1, 1, 1]
    w = [1.0, 2.0, 1.0, 4.0]
    m = SG.AveragedSGD(maxIter=1, batchRows=10, weightCol="weight").fit(table(spark, x, y, weight=w).coalesce(1))
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((4, 1))])
    for c in (0, 1):
        t = np.where(np.array(y) == c, 1.0, -1.0)
        g = z.T @ (-t * np.array(w) * 0.5) / sum(w)
        steps = -0.1 * g / np.sqrt(g * g + 1e-12)
        coef = steps[:2] / x.std(0)
        assert np.allclose(m.coef[c], coef, atol=1e-9)
        assert m.intercept[c] == pytest.approx(steps[2] - x.mean(0) @ coef, abs=1e-9)


def test_as_good_as_full_passes_and_sorted_rows_do_no_harm(spark):
    x, y = blobs()
    order = np.argsort(y, kind="stable")
    df = table(spark, x[order], y[order]).repartitionByRange(4, "label")
    whole = accuracy(M.ovr_logistic().fit(df), df)
    for rows in (200, 100_000):  # many tasks and one
        SG_rows, SG.PART_ROWS = SG.PART_ROWS, rows
        try:
            m = SG.AveragedSGD().fit(df)
        finally:
            SG.PART_ROWS = SG_rows
        assert accuracy(m, df) >= whole - 0.01
    assert accuracy(SG.AveragedSGD(loss="hinge").fit(df), df) >= whole - 0.01


def test_probabilities_score_and_saving(spark, tmp_path):
    x, y = blobs(600, 2)
    df = table(spark, x, y)
    m = Pipeline(stages=[SG.AveragedSGD(maxIter=5)]).fit(df)
    m.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    a, b = (M.score(t, df).orderBy("id").collect() for t in (m, back))
    assert a == b
    p = [r.p for r in m.transform(df).select(vector_to_array("probability").alias("p")).collect()]
    assert all(abs(sum(v) - 1) < 1e-12 and min(v) >= 0 for v in p)


def test_weights_move_the_border(spark):
    g = np.random.default_rng(3)
    y = (g.random(4000) < 0.1).astype(int)
    df = table(spark, (g.normal(size=(4000, 2)) + y[:, None]).tolist(), y, weight=np.where(y == 1, 10.0, 1.0).tolist())
    plain, heavy = SG.AveragedSGD().fit(df), SG.AveragedSGD(weightCol="weight").fit(df)
    found = [m.transform(df).where("label = 1").agg(F.avg("prediction")).first()[0] for m in (plain, heavy)]
    assert found[1] > found[0] + 0.3


def test_odd_rows(spark):
    x, y = [[1.0, 2.0], [3.0, 2.0], [2.0, 2.0]], [1, 1, 1]
    m = SG.AveragedSGD().fit(table(spark, x, y))  # one class, one constant feature
    assert accuracy(m, table(spark, x, y)) == 1.0
    for bad in (table(spark, x, [1, None, 0]), table(spark, [[1.0, math.nan]] * 3, y), table(spark, [[1.0, math.inf]] * 3, y),
                table(spark, x, [1, math.nan, 0]), table(spark, x, y).limit(0)):
        with pytest.raises(ValueError):
            SG.AveragedSGD().fit(bad)
    for w in ([1.0, -1.0, 1.0], [1.0, None, 1.0]):
        with pytest.raises(ValueError):
            SG.AveragedSGD(weightCol="weight").fit(table(spark, x, y, weight=w))
    with pytest.raises(ValueError):
        SG.AveragedSGD(loss="squared").fit(table(spark, x, y))
    none = SG.AveragedSGD(weightCol="weight").fit(table(spark, x + [[99.0, 9.0]], [1, 1, 1, 0], weight=[1.0, 1.0, 1.0, 0.0]))
    assert none.classes == [1.0]  # weight 0 takes no part


def circles(n, seed):
    g = np.random.default_rng(seed)
    y = g.integers(0, 2, n)
    a, r = g.uniform(0, 2 * math.pi, n), np.where(y == 1, 1.0, 2.0) + g.normal(0, 0.25, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], axis=1), y


def exact_kernel_machine(x, y, test, gamma, reg=1e-4, rounds=60):
    """Dual coordinate ascent on the full kernel matrix (a constant added for the intercept)."""
    def kern(a, b):
        return np.exp(-gamma * ((a[:, None, :] - b[None]) ** 2).sum(-1)) + 1.0
    q, t, n = kern(x, x), np.where(y == 1, 1.0, -1.0), len(x)
    alpha, f, c = np.zeros(n), np.zeros(n), 1.0 / (reg * n)
    for _ in range(rounds):
        for i in range(n):
            new = min(max(alpha[i] + (1 - t[i] * f[i]) / q[i, i], 0.0), c)
            f += (new - alpha[i]) * t[i] * q[i]
            alpha[i] = new
    return (kern(test, x) @ (alpha * t) > 0).astype(int)


def test_kernel_machine_on_circles(spark):
    (x, y), (u, v) = circles(600, 1), circles(2000, 2)
    sd, mean = x.std(0, ddof=1), x.mean(0)
    exact = (exact_kernel_machine((x - mean) / sd, y, (u - mean) / sd, 0.5) == v).mean()
    m = KE.kernel_svm().fit(table(spark, x, y))
    got = accuracy(m, table(spark, u, v))
    line = accuracy(M.linear_svm().fit(table(spark, x, y)), table(spark, u, v))
    assert exact > 0.9 and abs(got - exact) <= 0.02 and line < 0.7


def test_fourier_features_come_near_the_kernel(spark, tmp_path):
    g = np.random.default_rng(5)
    x = g.normal(size=(40, 5))
    df = table(spark, np.vstack([x, np.zeros(5)]), [0.0] * 41).withColumn("features", F.expr("if(id = 40, null, features)"))
    t = KE.FourierFeatures(components=20_000, gamma=0.2, seed=7)
    t.write().save(str(tmp_path / "t"))
    rows = [KE.FourierFeatures.load(str(tmp_path / "t")).transform(d).select("id", "fourier").orderBy("id").collect()
            for d in (df, df.repartition(7))]
    assert rows[0] == rows[1] and rows[0][-1].fourier is None
    z = np.array([r.fourier.toArray() for r in rows[0][:-1]])
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_kernel_learner_reads_bounded_partitions(spark, monkeypatch):
    """The wide features of a partition stay below a bound, whatever the rows' own partitions hold."""
    from loanlab.operators import kernel as K
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), float((x[i] ** 2).sum() > 2.4)) for i in range(600)],
                               "id long, x array<double>, label double")
    df = df.select("id", array_to_vector("x").alias("features"), "label").coalesce(1)
    seen, fit = [], K.LinearSVC._fit
    monkeypatch.setattr(K.LinearSVC, "_fit", lambda self, d: seen.append(d.rdd.getNumPartitions()) or fit(self, d))
    plain = K.kernel_svm(components=32).fit(df).transform(df).orderBy("id").collect()
    monkeypatch.setattr(K, "PART_BYTES", 32 * 8 * 100)
    spread = K.kernel_svm(components=32).fit(df).transform(df).orderBy("id").collect()
    assert seen == [1, 6]
    assert np.mean([a.prediction == b.prediction for a, b in zip(plain, spread, strict=True)]) > 0.99


def test_kernel_learner_minimises_sparks_objective_and_holds_no_features(spark, monkeypatch):
    """As low a loss as Spark's learner on the same features, which are made in passes and kept nowhere."""
    from loanlab.operators import kernel as K
    x, y = circles(900, 3)
    df = table(spark, x, y).repartition(3).persist()
    monkeypatch.setattr(K, "BLOCK_ROWS", 100)
    kept = []
    monkeypatch.setattr(K, "scratch_path", lambda s, name, f=K.scratch_path: kept.append(f(s, name)) or kept[-1])
    model = K.kernel_svm(components=64).fit(df)
    assert len(kept) == 1 and len(spark.read.parquet(kept[0]).first().x) == 2 * 4 * spark.read.parquet(kept[0]).first().n
    wide = model.transform(df).drop("prediction", "rawPrediction").persist()
    plain = K.SparkLinearSVC(regParam=1e-4, maxIter=50, featuresCol="_fourier", labelCol="label").fit(wide)
    z = np.array([r._fourier.toArray() for r in wide.orderBy("id").collect()])
    sign = np.array([2 * r.label - 1 for r in wide.orderBy("id").collect()])

    def loss(m):
        c = m.coefficients.toArray()
        return np.maximum(0, 1 - sign * (z @ c + m.intercept)).mean() + 0.5e-4 * ((c * z.std(axis=0, ddof=1)) ** 2).sum()
    assert loss(model.stages[-1]) <= 1.03 * loss(plain)
    same = [a.prediction == b.prediction for a, b in zip(model.transform(df).orderBy("id").collect(), plain.transform(wide).orderBy("id").collect())]
    assert np.mean(same) > 0.98
    with pytest.raises(Exception):
        K.kernel_svm(components=8).fit(table(spark, x[:5], [0, 1, 2, 0, 1]))
