"""Learners on blocks of byte columns, and scores that read a row's features once (findings of round 3)."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from loanlab.operators import forest as FO, models as M
from loanlab.operators.adaboost import AdaBoost
from loanlab.operators.boost import FirstOrderBoost, NewtonBoost
from loanlab.operators.discriminant import DiscriminantAnalysis


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(5)
    x = np.round(g.normal(size=(600, 4)), 1)
    x[:, 3] = x[:, 3] > 0.5
    y = (x[:, 0] + x[:, 1] ** 2 + x[:, 3] + g.normal(0, 0.5, 600) > 0.8).astype(float)
    data = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "id long, x array<double>, label double").withColumn("features", array_to_vector("x"))


def test_first_order_boosting_is_sparks(rows):
    own = M.gradient_boosted_trees(max_depth=3, max_iter=5, max_bins=128)
    assert isinstance(own, FirstOrderBoost)
    a, b = own.fit(rows), GBTClassifier(maxDepth=3, maxIter=5, stepSize=0.1, maxBins=128).fit(rows)
    got, want = ([tuple(r) for r in m.transform(rows).orderBy("id").select(
        vector_to_array("rawPrediction")[1], vector_to_array("probability")[1], "prediction").collect()] for m in (a, b))
    assert np.allclose(got, want, atol=1e-12)
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), atol=1e-9)


@pytest.mark.parametrize("learner", [NewtonBoost(maxIter=3), AdaBoost(maxIter=3), DiscriminantAnalysis()], ids=["newton", "ada", "lda"])
def test_scoring_reads_the_features_once(rows, learner):
    out = learner.fit(rows).transform(rows).select("id", "probability", "prediction")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1  # and no lambda that would convert the vector at each use
    assert "lambdafunction" not in plan.lower() and "lambda " not in plan.lower()


def test_blocks_hold_all_rows_and_their_sums(spark, rows):
    bounds = FO.feature_bounds(rows, max_bins=32, middle=True)
    table = FO.binned(rows, bounds)
    found = FO.blocks(table.coalesce(1), len(bounds)).toArrow()
    assert found.num_rows == 1 and found.column("n").to_pylist() == [600]
    (_, n, cols, bins), = FO.chunks_of(found.to_batches(), len(bounds))
    plain = table.coalesce(1).toArrow()
    want = np.array([list(b) for b in plain.column("bins").to_pylist()]).T
    assert (bins == want).all() and (cols["y"] == plain.column("y").to_numpy()).all()
    hist, slot, w = FO.Histogram(bounds, 33), np.arange(600) % 3, np.linspace(0.1, 2, 600)
    sums = hist.add(slot, 2, bins, [w])
    for node in range(2):
        for f in range(4):
            assert np.allclose(sums[node, 0, f], np.bincount(want[f][slot == node], w[slot == node], 33), atol=1e-12)
    assert len(bounds[3]) == 1  # the indicator


def test_missing_features_go_right(spark, rows):
    model = NewtonBoost(maxIter=2).fit(rows)
    odd = spark.createDataFrame([(1, [float("nan")] * 4), (2, [9e9] * 4)], "id long, x array<double>").withColumn(
        "features", array_to_vector("x"))
    a, b = (r.p for r in model.transform(odd).orderBy("id").select(F.col("probability").alias("p")).collect())
    assert a == b


def test_encoder_is_fitted_on_unranked_rows(spark, sf001, monkeypatch):
    """The folds' ranks are no part of the encoder's input: each of its fits would rank the rows again."""
    from loanlab.operators import features as FE
    from loanlab.plans import q_models as Q
    from loanlab.plans.registry import loans
    from loanlab.plans.workflows import prepare
    seen, real = [], FE.feature_pipeline

    def spy(*a, **kw):
        pipe = real(*a, **kw)
        fit = pipe.fit
        pipe.fit = lambda df: (seen.append((df._jdf.queryExecution().optimizedPlan().toString(), df.count())), fit(df))[1]
        return pipe
    monkeypatch.setattr(FE, "feature_pipeline", spy)
    p = prepare(loans(spark, sf001), Q.FIXTURE_STATUSES, Q.FIXTURE_FEATURES)
    (plan, n), = seen
    assert "Window" not in plan and n == p.train.count()
    p.unpersist()


def test_months_by_one_parse(spark):
    from loanlab.operators.features import _date_sql
    df = spark.createDataFrame([("Jan-1970",), ("Dec-1969",), ("Feb-2015",), (None,), ("odd",), ("Jan-1900",)], "d string")
    for s in (-99.0, 5.0):
        got = [r.v for r in df.selectExpr(f"{_date_sql('d', s, 'sentinel')} AS v").collect()]
        assert got == [0, int(s), 16467 * 86_400_000_000_000, int(s), int(s), int(s)]
    assert _date_sql("d", -99.0, "sentinel").count("try_to_date") == 1
