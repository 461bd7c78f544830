"""Registered queries: feature preparation (FEA-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import features as FE, split as S
from ..sources.fixture import FIXTURE_FEATURES, FIXTURE_STATUSES
from .q_explore import CLEAN_CTE, DEF_SQL, DEFAULT, PM, clean
from .registry import oracle, query, rnd

DATES = ["earliest_cr_line", "issue_d", "last_pymnt_d"]
DUMMIES = ["addr_state", "emp_length", "home_ownership", "term"]
NUMS = ["annual_inc", "dti", "loan_amnt", "open_acc", "recoveries", "total_acc"]


def _ns(c):
    e = f"epoch_ns(CAST({PM(c)} AS TIMESTAMP))"
    return f"CAST(coalesce(CASE WHEN {e} < 0 THEN -99 ELSE {e} END, -99) AS DOUBLE)"


_LONG = " UNION ALL ".join(
    [f"SELECT id, '{c}' AS feature, {_ns(c)} AS value FROM clean" for c in DATES]
    + [f"SELECT id, concat('{c}_', {c}) AS feature, CAST(1 AS DOUBLE) AS value FROM clean WHERE {c} IS NOT NULL"
       for c in DUMMIES]
    + ["SELECT id, 'sub_grade' AS feature, CAST(coalesce((ascii(substr(sub_grade, 1, 1)) - 65) * 5 "
       "+ CAST(substr(sub_grade, 2, 1) AS INTEGER), -99) AS DOUBLE) AS value FROM clean"]
    + [f"SELECT id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), -99) AS value FROM clean" for c in NUMS])


def _features_input(spark, sf):
    return clean(spark, sf).drop("score")


# DuckDB's round() is inexact on nanosecond-sized values; Spark's is exact there
_RV = "CASE WHEN abs(value) >= 1e9 THEN value ELSE round(value, 6) END AS value"


@query("transform_predictors", oracle(f"SELECT id, feature, {_RV} FROM ({_LONG})", CLEAN_CTE))
def q_transform_predictors(spark, sf):
    return rnd(FE.predictors_long(_features_input(spark, sf), FIXTURE_FEATURES))


@query("transform_predictors_vector", oracle(
    f"SELECT id, feature, {_RV} FROM ({_LONG}) WHERE value <> 0", CLEAN_CTE))
def q_transform_predictors_vector(spark, sf):
    df = _features_input(spark, sf)
    cols = [c for c in df.columns if c != "loan_status"]
    model = FE.feature_pipeline(cols, FIXTURE_FEATURES).fit(df.select(*cols))
    names = FE.feature_names(model, cols, FIXTURE_FEATURES)
    out = FE.vector_long(model.transform(df.select(*cols)), names)
    return rnd(out.filter(F.col("value") != 0))


@query("one_hot", oracle(" UNION ALL ".join(
    f"SELECT id, concat('{c}_', {c}) AS feature FROM clean WHERE {c} IS NOT NULL" for c in DUMMIES), CLEAN_CTE))
def q_one_hot(spark, sf):
    return FE.one_hot_long(clean(spark, sf), DUMMIES)


@query("one_hot_vocabulary", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS \"index\" "
    f"FROM (SELECT DISTINCT {c} AS value FROM clean WHERE {c} IS NOT NULL)" for c in DUMMIES), CLEAN_CTE))
def q_one_hot_vocabulary(spark, sf):
    df = clean(spark, sf)
    im = FE.feature_pipeline(DUMMIES, FIXTURE_FEATURES).getStages()[1].fit(df.select(*DUMMIES))
    rows = [(c, v, i) for c, labels in zip(DUMMIES, im.labelsArray) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "column string, value string, index int")


@query("label_encode", oracle(
    "SELECT id, CAST(dense_rank() OVER (ORDER BY loan_status) - 1 AS DOUBLE) AS label_idx FROM loans"))
def q_label_encode(spark, sf):
    df = clean(spark, sf).select("id", "loan_status")
    return FE.label_indexer().fit(df).transform(df).select("id", "label_idx")


@query("make_multiclass", oracle(
    "SELECT id, CAST(dense_rank() OVER (ORDER BY loan_status) - 1 AS DOUBLE) AS label_idx, "
    "CAST(dense_rank() OVER (ORDER BY loan_status) - 1 AS INTEGER) AS hot_slot, loan_status AS decoded FROM loans"))
def q_make_multiclass(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = clean(spark, sf).select("id", "loan_status")
    enc, im = FE.make_multiclass(df)
    arr = vector_to_array("label_vec")
    # inverse of the one-hot vector: position of its maximum, decoded by name
    enc = enc.withColumn("hot_slot", (F.array_position(arr, F.array_max(arr)) - 1).cast("int"))
    dec = FE.decode_labels(enc.withColumn("_slot", F.col("hot_slot").cast("double")), im, "_slot", "decoded")
    return dec.select("id", "label_idx", "hot_slot", "decoded")


_TRAIN = f"NOT (substr(md5(concat(CAST(id AS VARCHAR), ':123')), 1, 8) < '{S.hex_bound(0.3)}')"
_STD = ["loan_amnt", "annual_inc", "dti"]


@query("standardize", oracle(
    "SELECT id, " + ", ".join(f"round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in _STD)
    + " FROM loans, st",
    ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _STD)
    + f" FROM loans WHERE {_TRAIN})"))
def q_standardize(spark, sf):
    from .registry import loans
    df = loans(spark, sf).select("id", *_STD)
    train = S.train_test_split(df, 0.3, seed=123, exact=False).filter(~F.col("is_test"))
    return rnd(FE.standardize(df, _STD, fit_df=train))


_NRM = ["loan_amnt", "annual_inc", "total_acc"]
_NORM_SQL = "sqrt(" + " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0) * coalesce(CAST({c} AS DOUBLE), 0)" for c in _NRM) + ")"


@query("row_normalize", oracle(
    "SELECT id, " + ", ".join(f"round(CASE WHEN {_NORM_SQL} > 0 THEN {c} / {_NORM_SQL} ELSE 0 END, 6) AS {c}" for c in _NRM)
    + " FROM loans"))
def q_row_normalize(spark, sf):
    from .registry import loans
    return rnd(FE.row_normalize(loans(spark, sf).select("id", *_NRM), _NRM))


_SK = ["annual_inc", "dti", "loan_amnt", "open_acc", "recoveries", "total_acc"]
_SKEW_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT avg(power(CAST({c} AS DOUBLE) - m, 3)) / power(avg(power(CAST({c} AS DOUBLE) - m, 2)), 1.5) "
    f"FROM loans, (SELECT avg(CAST({c} AS DOUBLE)) AS m FROM loans) mm WHERE {c} IS NOT NULL) AS skew" for c in _SK)


@query("log_skewed", oracle(
    "SELECT v.id, v.feature, round(CASE WHEN v.x + 10 > 0 THEN ln(v.x + 10) END, 6) AS value FROM ("
    + " UNION ALL ".join(f"SELECT id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM loans" for c in _SK)
    + f") v JOIN ({_SKEW_SQL}) k ON v.feature = k.feature WHERE k.skew >= 1"))
def q_log_skewed(spark, sf):
    from .registry import loans
    df = loans(spark, sf).select("id", *_SK)
    out, chosen = FE.log_skewed(df, _SK, 1.0)
    if not chosen:
        return spark.createDataFrame([], "id bigint, feature string, value double")
    long = out.select("id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in chosen])).alias("_s"))
    return rnd(long.select("id", "_s.feature", "_s.value"))


_CHI = ["dti", "loan_amnt", "open_acc", "recoveries", "total_acc", "sub_grade_num"]
_CHI_CTE = (f", t AS (SELECT CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS label, dti, loan_amnt, open_acc, "
            "recoveries, total_acc, (ascii(substr(sub_grade, 1, 1)) - 65) * 5 + CAST(substr(sub_grade, 2, 1) AS INTEGER) "
            "AS sub_grade_num FROM loans), "
            "o AS (" + " UNION ALL ".join(
                f"SELECT '{c}' AS feature, label, count(*) AS nc, coalesce(sum(CAST({c} AS DOUBLE)), 0) AS obs FROM t GROUP BY label"
                for c in _CHI) + "), "
            "e AS (SELECT feature, obs, CAST(nc AS DOUBLE) / sum(nc) OVER (PARTITION BY feature) * sum(obs) OVER (PARTITION BY feature) "
            "AS ex FROM o), "
            "c2 AS (SELECT feature, sum(CASE WHEN ex > 0 THEN (obs - ex) * (obs - ex) / ex ELSE 0 END) AS chi2 FROM e GROUP BY feature)")


def _chi_input(spark, sf):
    from .registry import loans
    return loans(spark, sf).select(X.is_default("loan_status", DEFAULT).alias("label"), "dti", "loan_amnt",
                                   "open_acc", "recoveries", "total_acc",
                                   X.sub_grade_ordinal("sub_grade").alias("sub_grade_num"))


@query("chi2_scores", oracle("SELECT feature, round(chi2, 6) AS chi2 FROM c2", _CHI_CTE))
def q_chi2_scores(spark, sf):
    return rnd(FE.chi2_scores(_chi_input(spark, sf), "label", _CHI))


@query("select_k_best_chi2", oracle(
    "SELECT CAST(row_number() OVER (ORDER BY chi2 DESC, feature) AS INTEGER) AS rank, feature FROM c2 "
    "QUALIFY rank <= 2", _CHI_CTE))
def q_select_k_best_chi2(spark, sf):
    names = FE.select_k_best(FE.chi2_scores(_chi_input(spark, sf), "label", _CHI), 2)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank int, feature string")


@query("sample_weight", oracle(
    f"SELECT id, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS label, "
    f"CASE WHEN loan_status IN {DEF_SQL} THEN CAST(5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM loans"))
def q_sample_weight(spark, sf):
    from .registry import loans
    df = loans(spark, sf).select("id", X.is_default("loan_status", DEFAULT).alias("label"))
    return FE.sample_weight(df, "label", 5.0)


@query("class_weights", oracle(
    f"SELECT id, loan_status, CASE WHEN loan_status IN {DEF_SQL} THEN CAST(10 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END "
    "AS weight FROM loans"))
def q_class_weights(spark, sf):
    from .registry import loans
    df = loans(spark, sf).select("id", "loan_status")
    return FE.class_weights(df, "loan_status", {s: 10.0 for s in FIXTURE_STATUSES.default})
