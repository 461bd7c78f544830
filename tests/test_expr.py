import datetime as dt

from pyspark.sql import functions as F

from loanlab.functions import expr as X
from loanlab.sources.loans import null_sentinel


def test_missing_frame(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, "Jan-2015"), (2, "n/a", None, "n/a"), (3, None, 3.0, "Dec-1969"),
         (4, "b", 4.0, "garbage"), (5, "n/a", 5.0, None)],
        "id int, s string, x double, d string")
    c = null_sentinel(df).orderBy("id").collect()
    assert [r.s for r in c] == ["a", None, None, "b", None]
    assert c[3].d == "garbage"  # only the whole-cell sentinel is missing
    out = df.select("id", X.parse_month("d").alias("m"),
                    X.date_to_ns(X.parse_month("d")).alias("ns"),
                    X.date_to_ns(X.parse_month("d"), pre_epoch="keep").alias("ns_keep")).orderBy("id").collect()
    assert out[0].m == dt.date(2015, 1, 1)
    assert out[0].ns == (dt.date(2015, 1, 1) - dt.date(1970, 1, 1)).days * 86_400_000_000_000
    assert [r.ns for r in out[1:]] == [-99, -99, -99, -99]     # missing, pre-1970, unparsable
    assert out[2].ns_keep == (dt.date(1969, 12, 1) - dt.date(1970, 1, 1)).days * 86_400_000_000_000


def test_strings(spark):
    df = spark.createDataFrame([("A1",), ("G5",), ("C3",)], "g string")
    r = df.select(X.sub_grade_ordinal("g").alias("o"), X.first_char("g").alias("f")).collect()
    assert [x.o for x in r] == [1, 35, 13]
    assert [x.f for x in r] == ["A", "G", "C"]
    names = spark.createDataFrame([("verification_status_joint_Not Verified",), ("short",), ("emp_length_< 1 year",)], "n string")
    r = names.select(X.shorten("n").alias("s"), X.clean_name("n").alias("c"), X.last_two("n").alias("l")).collect()
    assert r[0].s == "verifi..ot Verified" and r[1].s == "short"
    assert r[2].c == "emp_length_- 1 year"
    assert r[1].l == "rt"


def test_maths_and_status(spark):
    df = spark.createDataFrame([(-20.0,), (-10.0,), (0.0,), (90.0,)], "x double")
    r = df.select(X.log_shift("x").alias("l"), X.negative_to("x").alias("n")).collect()
    assert r[0].l is None and r[1].l is None
    assert abs(r[3].l - 4.605170185988092) < 1e-12
    assert [x.n for x in r] == [-99.0, -99.0, 0.0, 90.0]
    st = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    r = st.select(X.is_default("s", ["a"]).alias("d"), X.binary_label("s", ["a"]).alias("l")).collect()
    assert [x.d for x in r] == [1, 0, 0]
    assert [x.l for x in r] == ["Default", "Non-default", "Non-default"]
    z = spark.createDataFrame([(1, 0), (0, 0)], "x int, n int")
    assert [r.p for r in z.select(X.safe_ratio("x", "n").alias("p")).collect()] == [0.0, 0.0]
