"""Registered queries: evaluation (EVA-*), windows (WIN-*), threshold
selection (SRT-5, JN-7) and splitting (VAL-1..3, VAL-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evaluate as V, explore as E, split as S
from .q_explore import DEF_SQL, DEFAULT, SCORED_CTE, scored_fixture
from .registry import loans, oracle, query, rnd

SC = SCORED_CTE
COUNTS = (", c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, "
          "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, "
          "count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, "
          "count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM {src})")
CELLS = ("SELECT 0 AS label, 0 AS prediction, tn AS n FROM c UNION ALL SELECT 0, 1, fp FROM c "
         "UNION ALL SELECT 1, 0, fn FROM c UNION ALL SELECT 1, 1, tp FROM c")


def _fb(b):
    b2 = float(b) ** 2
    return (f"round(coalesce((1 + {b2}) * tp / nullif((1 + {b2}) * tp + {b2} * fn + fp, 0), 0), 6)")


def _div(a, b):
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


@query("confusion_matrix", oracle(CELLS, SC + COUNTS.format(src="scored")))
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix(scored_fixture(spark, sf))


@query("confusion_share", oracle(
    f"SELECT label, prediction, n, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (), 1) AS pct FROM ({CELLS})",
    SC + COUNTS.format(src="scored")))
def q_confusion_share(spark, sf):
    return V.confusion_share(scored_fixture(spark, sf))


_METRICS = ("SELECT tp, fp, fn, tn, " + _div("tp + tn", "tp + fp + fn + tn") + " AS accuracy, "
            + _div("tp", "tp + fn") + " AS recall, " + _div("tp", "tp + fp") + " AS precision, "
            + _div("fp", "fp + tn") + " AS fpr, " + _fb(1) + " AS f1, " + _fb(5) + " AS f5, "
            + _fb(10) + " AS f10 FROM c")


@query("binary_metrics", oracle(_METRICS, SC + COUNTS.format(src="scored")))
def q_binary_metrics(spark, sf):
    return rnd(V.binary_metrics(scored_fixture(spark, sf)))


for _name, _cols in [("accuracy", "accuracy"), ("recall", "recall"), ("precision", "precision"),
                     ("false_positive_rate", "fpr"), ("fbeta", "f1, f5, f10")]:
    def _mk(cols):
        def fn(spark, sf):
            return rnd(V.binary_metrics(scored_fixture(spark, sf)).selectExpr(*[c.strip() for c in cols.split(",")]))
        return fn
    query(_name, oracle(f"SELECT {_cols} FROM ({_METRICS})", SC + COUNTS.format(src="scored")))(_mk(_cols))

CUT_CTE = (f", cut AS (SELECT CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS label, "
           "CAST(score > 0.29 AS INTEGER) AS prediction FROM loans)")


@query("matrix_at_cutoff", oracle(CELLS, CUT_CTE + COUNTS.format(src="cut")))
def q_matrix_at_cutoff(spark, sf):
    return V.matrix_at_cutoff(scored_fixture(spark, sf), 0.29)


def _sweep_cte(ts, betas):
    vals = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in ts)
    fb = "".join(f", {_fb(b)} AS f{b}" for b in betas)
    return (SC + ", sw AS (SELECT round(threshold, 6) AS threshold, tp, fp, fn, tn" + fb + " FROM (SELECT threshold, "
            "count(*) FILTER (WHERE label = 1 AND score > threshold) AS tp, "
            "count(*) FILTER (WHERE label = 0 AND score > threshold) AS fp, "
            "count(*) FILTER (WHERE label = 1 AND NOT score > threshold) AS fn, "
            "count(*) FILTER (WHERE label = 0 AND NOT score > threshold) AS tn "
            f"FROM scored, (VALUES {vals}) t(threshold) GROUP BY threshold))")


SWEEP1 = V.linspace(0.1, 0.4, 20)
SWEEP10 = V.linspace(0.01, 0.1, 20)


@query("threshold_sweep", oracle("SELECT * FROM sw", _sweep_cte(SWEEP1, [1, 5, 10])))
def q_threshold_sweep(spark, sf):
    return rnd(V.threshold_sweep(scored_fixture(spark, sf), SWEEP1, betas=(1, 5, 10)))


@query("threshold_cross", oracle("SELECT * FROM sw", _sweep_cte(SWEEP10, [10])))
def q_threshold_cross(spark, sf):
    return rnd(V.threshold_sweep(scored_fixture(spark, sf), SWEEP10, betas=(10,)))


@query("argmax_threshold", oracle(
    "SELECT min(threshold) AS threshold, max(f1) AS f1 FROM sw WHERE f1 = (SELECT max(f1) FROM sw)",
    _sweep_cte(SWEEP1, [1])))
def q_argmax_threshold(spark, sf):
    sweep = rnd(V.threshold_sweep(scored_fixture(spark, sf), SWEEP1, betas=(1,)))
    return V.argmax_threshold(sweep, "f1")


CUM = (", d AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg "
       "FROM scored WHERE score IS NOT NULL GROUP BY score), "
       "cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_tp, "
       "sum(neg) OVER (ORDER BY score DESC) AS cum_fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM d)")


@query("roc_cumulative", oracle(
    "SELECT round(score, 6) AS score, pos, neg, CAST(cum_tp AS BIGINT) AS cum_tp, CAST(cum_fp AS BIGINT) AS cum_fp FROM cum",
    SC + CUM))
def q_roc_cumulative(spark, sf):
    # buckets forced > 1 so the distributed (bucket + offset) path is what is checked
    c = V.cumulative_counts(scored_fixture(spark, sf), buckets=8)
    return rnd(c.select("score", "pos", "neg", "cum_tp", "cum_fp"))


@query("roc_previous_point", oracle(
    "SELECT round(score, 6) AS score, CAST(coalesce(lag(cum_tp) OVER (ORDER BY score DESC), 0) AS BIGINT) AS prev_tp, "
    "CAST(coalesce(lag(cum_fp) OVER (ORDER BY score DESC), 0) AS BIGINT) AS prev_fp FROM cum", SC + CUM))
def q_roc_previous_point(spark, sf):
    c = V.cumulative_counts(scored_fixture(spark, sf), buckets=8)
    return rnd(c.select("score", "prev_tp", "prev_fp"))


@query("roc_curve", oracle(
    "SELECT round(score, 6) AS threshold, round(cum_fp / N, 6) AS fpr, round(cum_tp / P, 6) AS tpr FROM cum "
    "UNION ALL SELECT round(max(score) + 1, 6), 0.0, 0.0 FROM cum", SC + CUM))
def q_roc_curve(spark, sf):
    return rnd(V.roc_curve(scored_fixture(spark, sf), buckets=4))


@query("auc", oracle(
    "SELECT round(sum((cum_fp / N - (cum_fp - neg) / N) * (cum_tp / P + (cum_tp - pos) / P) / 2), 6) AS auc FROM cum",
    SC + CUM))
def q_auc(spark, sf):
    return rnd(V.auc(scored_fixture(spark, sf)))


@query("pr_curve", oracle(
    "SELECT round(score, 6) AS threshold, round(cum_tp / (cum_tp + cum_fp), 6) AS precision, "
    "round(cum_tp / P, 6) AS recall FROM cum WHERE cum_tp - pos < P "
    "UNION ALL SELECT NULL, 1.0, 0.0", SC + CUM))
def q_pr_curve(spark, sf):
    return rnd(V.pr_curve(scored_fixture(spark, sf), buckets=4))


@query("threshold_for_recall", oracle(
    "SELECT round(score, 6) AS threshold, round(cum_tp / P, 6) AS recall, round(cum_tp / (cum_tp + cum_fp), 6) AS precision, "
    "round(cum_fp / N, 6) AS fpr FROM cum WHERE score = (SELECT max(score) FROM cum WHERE cum_tp / P >= 0.5)", SC + CUM))
def q_threshold_for_recall(spark, sf):
    return rnd(V.threshold_for_recall(scored_fixture(spark, sf), 0.5))


def _two_models(spark, sf):
    df = loans(spark, sf)
    label = X.is_default("loan_status", DEFAULT).alias("label")
    a = df.select(F.lit("fixture").alias("model"), "id", label, F.col("score"),
                  (F.col("score") > 0.5).cast("int").alias("prediction"))
    b = df.select(F.lit("leak").alias("model"), "id", label,
                  (F.col("recoveries") > 0).cast("double").alias("score"),
                  (F.col("recoveries") > 0).cast("int").alias("prediction"))
    return a.unionByName(b)


_MODELS = (f", m AS (SELECT 'fixture' AS model, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS label, score, "
           "CAST(score > 0.5 AS INTEGER) AS prediction FROM loans UNION ALL "
           f"SELECT 'leak', CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END, CAST(recoveries > 0 AS DOUBLE), "
           "CAST(recoveries > 0 AS INTEGER) FROM loans), "
           "d AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg "
           "FROM m GROUP BY model, score), "
           "cum AS (SELECT model, score, pos, neg, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS cum_tp, "
           "sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS cum_fp, sum(pos) OVER (PARTITION BY model) AS P, "
           "sum(neg) OVER (PARTITION BY model) AS N FROM d), "
           "a AS (SELECT model, sum((cum_fp / N - (cum_fp - neg) / N) * (cum_tp / P + (cum_tp - pos) / P) / 2) AS auc "
           "FROM cum GROUP BY model), "
           "s AS (SELECT model, avg(CAST(label = prediction AS DOUBLE)) AS accuracy, "
           "coalesce(count(*) FILTER (WHERE label = 1 AND prediction = 1) / nullif(count(*) FILTER (WHERE label = 1), 0), 0) AS recall "
           "FROM m GROUP BY model)")


@query("model_comparison", oracle(
    "SELECT s.model, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(auc, 6) AS auc "
    "FROM s JOIN a ON s.model = a.model", _MODELS))
def q_model_comparison(spark, sf):
    return rnd(V.model_comparison(_two_models(spark, sf), buckets=2))


@query("collapse_multiclass", oracle(
    f"SELECT id, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS true_default, "
    f"CASE WHEN (CASE WHEN score > 0.5 THEN loan_status ELSE 'F/5-LOW' END) IN {DEF_SQL} THEN 1 ELSE 0 END AS pred_default "
    "FROM loans"))
def q_collapse_multiclass(spark, sf):
    df = loans(spark, sf).withColumn(
        "pred_class", F.when(F.col("score") > 0.5, F.col("loan_status")).otherwise(F.lit("F/5-LOW")))
    df = V.collapse_multiclass(df, "loan_status", DEFAULT, "true_default")
    df = V.collapse_multiclass(df, "pred_class", DEFAULT, "pred_default")
    return df.select("id", "true_default", "pred_default")


@query("error_analysis", oracle(
    "SELECT loan_status, count(*) AS n, count(*) FILTER (WHERE label <> prediction) AS n_wrong, "
    "round(avg(CAST(label <> prediction AS DOUBLE)), 6) AS error_rate FROM scored GROUP BY 1", SC))
def q_error_analysis(spark, sf):
    return rnd(V.error_analysis(scored_fixture(spark, sf), "loan_status"))


@query("share_of_total", oracle(
    "SELECT loan_status, n, round(n / sum(n) OVER (), 6) AS share FROM "
    "(SELECT loan_status, count(*) AS n FROM loans WHERE loan_status IS NOT NULL GROUP BY 1)"))
def q_share_of_total(spark, sf):
    return rnd(E.value_shares(loans(spark, sf), "loan_status"))


# --- splitting -----------------------------------------------------------------------


def _h(seed):
    return f"md5(concat(CAST(id AS VARCHAR), ':{seed}'))"


@query("hash_rank", oracle(
    f"SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {_h(234)}, id) AS rank FROM scored", SC))
def q_hash_rank(spark, sf):
    return S.hash_rank(scored_fixture(spark, sf).select("id", "label"), seed=234, partition=["label"])


@query("train_test_split", oracle(
    f"SELECT id, row_number() OVER (ORDER BY {_h(123)}, id) <= ceil(0.3 * count(*) OVER ()) AS is_test FROM loans"))
def q_train_test_split(spark, sf):
    return S.train_test_split(loans(spark, sf).select("id"), 0.3, seed=123)


@query("train_test_split_hash", oracle(
    f"SELECT id, substr({_h(123)}, 1, 8) < '{S.hex_bound(0.3)}' AS is_test FROM loans"))
def q_train_test_split_hash(spark, sf):
    return S.train_test_split(loans(spark, sf).select("id"), 0.3, seed=123, exact=False)


@query("k_fold", oracle(
    f"SELECT id, CAST((row_number() OVER (ORDER BY {_h(0)}, id) - 1) % 10 AS INTEGER) AS fold FROM loans"))
def q_k_fold(spark, sf):
    return S.k_fold(loans(spark, sf).select("id"), 10, seed=0)


@query("stratified_k_fold", oracle(
    f"SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {_h(234)}, id) - 1) % 3 AS INTEGER) AS fold "
    "FROM scored", SC))
def q_stratified_k_fold(spark, sf):
    return S.stratified_k_fold(scored_fixture(spark, sf).select("id", "label"), "label", 3, seed=234)


@query("null_classifier", oracle(
    "SELECT round(avg(CAST(label = 0 AS DOUBLE)), 6) AS accuracy, count(*) FILTER (WHERE label = 0) AS tn, "
    "count(*) FILTER (WHERE label = 1) AS fn FROM scored "
    f"WHERE NOT (substr({_h(123)}, 1, 8) < '{S.hex_bound(0.3)}')", SC))
def q_null_classifier(spark, sf):
    df = S.train_test_split(scored_fixture(spark, sf), 0.3, seed=123, exact=False)
    return rnd(V.null_classifier(df.filter(~F.col("is_test"))))


SWEEP5 = V.linspace(0.4, 0.6, 20)


@query("threshold_sweep_f5", oracle("SELECT threshold, f5 FROM sw", _sweep_cte(SWEEP5, [5])))
def q_threshold_sweep_f5(spark, sf):
    return rnd(V.threshold_sweep(scored_fixture(spark, sf), SWEEP5, betas=(5,)).select("threshold", "f5"))
