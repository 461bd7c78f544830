import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from loanlab.operators import distribution as D, split as S


def _ids(spark, n=2000):
    return spark.range(n).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("label"))


def test_hash_rank_equals_row_number(spark):
    df = _ids(spark)
    got = {r.id: r.rank for r in S.hash_rank(df, seed=3, partition=["label"]).collect()}
    w = Window.partitionBy("label").orderBy(S.hash_key("id", 3), "id")
    ref = {r.id: r.rn for r in df.select("id", F.row_number().over(w).alias("rn")).collect()}
    assert got == ref


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_splits_stable_under_repartition(spark, parts):
    df = _ids(spark).repartition(parts)
    base = _ids(spark).coalesce(1)
    key = lambda d: sorted((r.id, r.is_test) for r in S.train_test_split(d, 0.3, 123).collect())
    assert key(df) == key(base)
    f = lambda d: sorted((r.id, r.fold) for r in S.stratified_k_fold(d, "label", 3, 234).collect())
    assert f(df) == f(base)


def test_exact_sizes_and_balance(spark):
    df = _ids(spark, 1001)
    t = S.train_test_split(df, 0.3, 123)
    assert t.filter("is_test").count() == math.ceil(0.3 * 1001)
    folds = S.stratified_k_fold(df, "label", 3, 234).groupBy("label", "fold").count().collect()
    by = {}
    for r in folds:
        by.setdefault(r.label, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by.values())
    s = S.bernoulli_sample(df, 0.25, 1).count()
    assert 180 < s < 320
    assert S.slice_first(df, 10).count() == 10


def test_exact_quantiles_hot_group(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.lognormvariate(0, 1)) for _ in range(3000)] + \
           [("cold", float(rnd.randint(0, 5))) for _ in range(40)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.p): r.q for r in D.exact_quantiles(df, "x", ps, ["g"], accuracy=20).collect()}
    for g in ("hot", "cold", "one"):
        v = np.array([x for k, x in rows if k == g])
        for p in ps:
            assert got[(g, p)] == pytest.approx(float(np.percentile(v, 100 * p)), rel=1e-12, abs=1e-12)


def test_box_stats_and_kde(spark):
    xs = [1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([("a", x) for x in xs], "g string, x double")
    b = D.box_stats(df, "x", ["g"]).first()
    q1, q3 = np.percentile(xs, 25), np.percentile(xs, 75)
    assert (b.q1, b.median, b.q3) == (q1, np.percentile(xs, 50), q3)
    assert b.whisker_hi == 5.0 and b.whisker_lo == 1.0 and b.n_outliers == 1
    data = [float(i % 17) + 0.5 * (i % 3) for i in range(300)]
    k = D.kde(spark.createDataFrame([(x,) for x in data], "v double"), "v", grid_points=50, bins=4096).collect()
    xsg = np.array([r.x for r in sorted(k, key=lambda r: r.i)])
    dens = np.array([r.density for r in sorted(k, key=lambda r: r.i)])
    v = np.array(data)
    h = v.std(ddof=1) * len(v) ** -0.2
    exact = np.exp(-0.5 * ((xsg[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert np.allclose(dens, exact, atol=2e-3)        # binned estimate of the exact density
    assert abs(np.trapezoid(dens, xsg) - 1.0) < 0.02


def test_whole_table_quantiles_and_box(spark):
    rnd = random.Random(4)
    xs = [rnd.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(3)
    got = {r.p: r.q for r in D.exact_quantiles(df, "x", [0.1, 0.5, 0.9], accuracy=20).collect()}
    for p in (0.1, 0.5, 0.9):
        assert got[p] == pytest.approx(float(np.percentile(xs, 100 * p)), abs=1e-12)
    b = D.box_stats(df, "x").first()
    assert b.median == pytest.approx(float(np.median(xs)), abs=1e-12) and b.n == 500


@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_quantiles_under_ties_nan_and_null_groups(spark, accuracy):
    rows = [(None if i % 4 == 0 else "g", 0.0 if i % 20 else float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows + [("g", float("nan")), ("g", None)], "g string, x double").repartition(5)
    ps = [0.0, 0.1, 0.5, 0.94, 0.95, 0.99, 1.0]
    got = {(r.g, r.p): r.q for r in D.exact_quantiles(df, "x", ps, ["g"], accuracy=accuracy).collect()}
    assert len(got) == 2 * len(ps)
    for g in (None, "g"):
        v = np.array([x for k, x in rows if k == g])
        for p in ps:
            assert got[(g, p)] == pytest.approx(float(np.percentile(v, 100 * p)), rel=1e-12, abs=1e-12)
    assert {r.g: r.n for r in D.box_stats(df, "x", ["g"], accuracy=accuracy).collect()} == {None: 1000, "g": 3000}


def test_brackets_that_fail_their_check_widen_to_the_whole_range(spark):
    xs = [float(i * 37 % 1009) for i in range(1000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for rounds in (1, 2):
        got = D.exact_quantiles(df, "x", [0.5], accuracy=1, max_rounds=rounds).first()
        assert got.q == pytest.approx(float(np.percentile(xs, 50)))


def test_quantiles_and_box_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert D.exact_quantiles(df, "x", [0.5]).count() == 0
    assert D.exact_quantiles(df, "x", [0.5], ["g"]).count() == 0
    assert D.box_stats(df, "x").first().n == 0
