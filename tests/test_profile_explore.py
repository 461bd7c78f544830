import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from loanlab.operators import explore as E, profile as P


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (3, "a", None), (4, "n/a", 10.0)],
                               "id int, s string, x double")
    nf = {r.column: (r.n_missing, r.share) for r in P.null_fraction(df).collect()}
    assert nf["s"] == (1, 0.25) and nf["x"] == (1, 0.25) and nf["id"] == (0, 0.0)
    dc = {r.column: r.n_distinct for r in P.distinct_count(df).collect()}
    assert dc["s"] == 3  # 'a', 'n/a' and missing counted once
    assert dc["x"] == 4
    sf = P.sentinel_fraction(df).collect()
    assert [(r.column, r.n_sentinel) for r in sf] == [("s", 1)]
    sk = {r.column: r.skewness for r in P.column_skewness(df, ["x"]).collect()}
    v = np.array([1.0, 2.0, 10.0])
    m = v.mean()
    expect = ((v - m) ** 3).mean() / ((v - m) ** 2).mean() ** 1.5
    assert abs(sk["x"] - expect) < 1e-9
    assert P.row_count(df).first().n_columns == 3
    prof = {r.column: (r.dtype, r.non_null) for r in P.column_profile(df).collect()}
    assert prof["x"] == ("double", 3)


def test_calendar_fill_gap(spark):
    rows = [("s", dt.date(2020, 1, 31), 3), ("s", dt.date(2020, 4, 30), 1), ("t", dt.date(2020, 2, 29), 5)]
    counts = spark.createDataFrame(rows, "loan_status string, month date, n long")
    out = sorted((r.loan_status, r.month, r.n) for r in E.month_calendar_fill(counts, ["loan_status"]).collect())
    assert out == [("s", dt.date(2020, 1, 31), 3), ("s", dt.date(2020, 2, 29), 0), ("s", dt.date(2020, 3, 31), 0),
                   ("s", dt.date(2020, 4, 30), 1), ("t", dt.date(2020, 2, 29), 5)]


def test_bincount_histogram_value_counts(spark):
    df = spark.createDataFrame([(0,), (3,), (3,), (None,)], "v int")
    assert sorted((r.value, r.n) for r in E.bincount(df, "v").collect()) == [(0, 1), (1, 0), (2, 0), (3, 2)]
    h = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x double")
    hist = {r.bin: r.n for r in E.histogram(h, "x", 5).collect()}
    assert hist[4] == 1 and sum(hist.values()) == 6   # max falls in the last (closed) bin
    vc = E.value_counts(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "s string"), "s").collect()
    assert [(r.s, r.n) for r in vc] == [("a", 2), ("b", 1)]  # missing key skipped


def test_monthly_one_pass(spark):
    df = spark.createDataFrame([("Jan-2015", "A", 1.0), ("Jan-2015", "B", 2.0), ("Mar-2015", "A", None),
                                ("n/a", "A", 4.0)], "issue_d string, loan_status string, loan_amnt double")
    m = {r.month: (r.total, r.n) for r in E.monthly(df, "issue_d", "loan_amnt").collect()}
    assert m[dt.date(2015, 1, 31)] == (3.0, 2)
    assert m[dt.date(2015, 3, 31)] == (None, 0)
    mc = E.monthly_count_by_status(df, "issue_d", ["B"]).collect()
    assert sorted((r.loan_status, r.n, r.is_default) for r in mc) == [("A", 1, 0), ("A", 1, 0), ("B", 1, 1)]
