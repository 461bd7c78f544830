"""Densities per group (PLT-2)."""

import datetime
import math

import numpy as np
import pytest

from loanlab.operators import distribution as D


def exact(v, points=100, cut=3.0):
    v = np.array(v, float)
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - cut * h, v.max() + cut * h, points)
    return x, np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))


def test_groups_odd_and_skewed(spark):
    g = np.random.default_rng(2)
    groups = {"a": g.normal(size=3000).tolist(), "skewed": g.uniform(size=500).tolist() + [1e6],
              None: g.normal(50, 9, 200).tolist(), "one": [4.0], "same": [7.0] * 5, "none": [None, math.nan]}
    df = spark.createDataFrame([(k, v, 1) for k, vs in groups.items() for v in vs], "k string, v double, extra int")
    got = {}
    for r in D.kde_by(df.repartition(5), "v", ["k"]).collect():
        got.setdefault(r.k, []).append((r.i, r.x, r.density))
    assert set(got) == {"a", "skewed", None, "one", "same"}
    assert got["one"] == [(0, 4.0, None)] and got["same"] == [(0, 7.0, None)]
    for k in ("a", "skewed", None):
        rows, (x, d) = sorted(got[k]), exact(groups[k])
        assert [r[0] for r in rows] == list(range(100))
        assert np.allclose([r[1] for r in rows], x, rtol=1e-12, atol=1e-9)
        assert np.allclose([r[2] for r in rows], d, rtol=1e-8, atol=1e-16 + 1e-12 * d.max())


def test_group_of_all_rows_is_the_whole_density(spark):
    v = np.random.default_rng(4).exponential(size=400).tolist()
    df = spark.createDataFrame([(1, 2, a) for a in v], "k int, m int, v double")
    one = D.kde_by(df, "v", ["k", "m"]).orderBy("i").collect()
    all_ = D.kde(df, "v").orderBy("i").collect()
    assert [r.density for r in one] == pytest.approx([r.density for r in all_], rel=1e-12)


def test_dates_and_an_empty_table(spark):
    days = [datetime.date(2015, 1, 1) + datetime.timedelta(n * n) for n in range(30)]
    df = spark.createDataFrame([("x", d) for d in days] + [("x", None)], "k string, d date")
    x, d = exact([(a - datetime.date(1970, 1, 1)).days for a in days])
    rows = D.kde_by(df, "d", ["k"]).orderBy("i").collect()
    assert np.allclose([r.x for r in rows], x) and np.allclose([r.density for r in rows], d, rtol=1e-8)
    assert D.kde_by(df.limit(0), "d", ["k"]).count() == 0
