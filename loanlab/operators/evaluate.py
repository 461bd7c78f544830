"""Evaluation of scored tables ``(id, label, score, prediction)``.

Confusion matrices, accuracy/recall/precision/F-beta, threshold sweeps, ROC
and precision-recall curves, AUC, model comparison and error analysis, all as
aggregations.

Global order (ROC/PR) at scale
------------------------------
Cumulative true/false positives in descending score order need a global
order. Rows are first collapsed to one row per distinct score (partial
aggregation, ties kept together). If the distinct scores are many, they are
cut into score ranges ("buckets", boundaries from an approximate quantile
sketch, a bounded list on the driver); each bucket is ordered by its own
window task and shifted by the exact totals of all higher buckets (a
bucket-sized table, broadcast). No window ever runs over the whole table in
one task.

A NULL label, prediction or score is an error: no row is left out silently.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expr import is_default
from ..session import scratch_path
from ._util import join_groups, join_small

# --- metric expressions --------------------------------------------------------


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _given(name: str):
    """The column; a NULL in it is an error, as a row without it would be missing from the counts."""
    c = F.col(name)
    return F.when(c.isNull(), F.raise_error(F.lit(f"NULL in {name}: rows cannot be evaluated"))).otherwise(c)


def fbeta_expr(tp, fp, fn, beta: float):
    """EVA-7: (1+b^2) tp / ((1+b^2) tp + b^2 fn + fp); 0 when undefined."""
    b2 = F.lit(float(beta) ** 2)
    num = (F.lit(1.0) + b2) * tp
    return _ratio(num, num + b2 * fn + fp)


def _counts(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    y = _given(label).cast("int") == 1
    p = _given(prediction).cast("int") == 1
    return scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                      F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def binary_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                   betas: Iterable[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """EVA-3..7: one row with the 2x2 counts, accuracy, recall, precision,
    false-positive rate and F-beta scores (division by zero gives 0)."""
    c = _counts(scored, label, prediction)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    out = c.select(
        "tp", "fp", "fn", "tn",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(fp, fp + tn).alias("fpr"),
        *[fbeta_expr(tp, fp, fn, b).alias(f"f{int(b) if float(b).is_integer() else b}")
          for b in betas])
    return out


def confusion_matrix(scored: DataFrame, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """EVA-1: counts per (label, prediction), all four cells present.

    One algebraic aggregation (four conditional counts), then the fixed
    2x2 layout -- no join."""
    c = _counts(scored, label, prediction)
    cells = F.array(
        F.struct(F.lit(0).alias("label"), F.lit(0).alias("prediction"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("label"), F.lit(1).alias("prediction"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(0).alias("prediction"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(1).alias("prediction"), F.col("tp").alias("n")))
    return c.select(F.explode(cells).alias("_c")).select("_c.*")


def confusion_share(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                    digits: int = 1) -> DataFrame:
    """EVA-2: the matrix as a percentage of all rows, rounded."""
    m = confusion_matrix(scored, label, prediction)
    total = F.sum("n").over(Window.partitionBy())  # 4 rows
    return m.select("label", "prediction", "n",
                    F.round(F.lit(100.0) * F.col("n") / total, digits).alias("pct"))


def at_cutoff(scored: DataFrame, threshold: float, score: str = "score",
              out: str = "prediction") -> DataFrame:
    """EVA-8: predictions from a strict cut-off, ``score > threshold``."""
    return scored.withColumn(out, (F.col(score) > F.lit(float(threshold))).cast("int"))


def matrix_at_cutoff(scored: DataFrame, threshold: float, label: str = "label",
                     score: str = "score") -> DataFrame:
    """EVA-8: confusion matrix at a chosen cut-off."""
    return confusion_matrix(at_cutoff(scored, threshold, score, "_pred"), label, "_pred")


def linspace(lo: float, hi: float, n: int) -> list:
    """Evenly spaced cut-offs, both ends included (the sweep grid)."""
    if n == 1:
        return [float(lo)]
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def threshold_sweep(scored: DataFrame, thresholds: Iterable[float], label: str = "label",
                    score: str = "score", betas: Iterable[float] = (1.0,)) -> DataFrame:
    """EVA-9 / JN-7: confusion counts and F-beta at every cut-off in one pass.

    Each score is mapped to the number of cut-offs strictly below it (its
    bucket); one ``groupBy(bucket)`` gives at most len(thresholds)+1 rows, and
    a suffix sum over that tiny table gives, for cut-off i, the positives with
    ``score > t_i``. No per-threshold scan and no row x threshold join.
    """
    ts = sorted(float(t) for t in thresholds)
    k = len(ts)
    y = _given(label).cast("int") == 1
    scored = scored.withColumn(score, _given(score))
    bucket = sum((F.col(score) > F.lit(t)).cast("int") for t in ts) if ts else F.lit(0)
    counts = (scored.groupBy(bucket.alias("bucket"))
              .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    spark = scored.sparkSession
    grid = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ts)] + [(0, None)],
                                 "bucket int, threshold double")
    full = grid.join(F.broadcast(counts), "bucket", "left").fillna(0, ["pos", "neg"])
    suffix = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    allw = Window.partitionBy()
    swept = (full.withColumn("tp", F.sum("pos").over(suffix))
             .withColumn("fp", F.sum("neg").over(suffix))
             .withColumn("P", F.sum("pos").over(allw))
             .withColumn("N", F.sum("neg").over(allw))
             .filter(F.col("bucket") >= 1))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return swept.select(
        "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        *[fbeta_expr(tp, fp, fn, b).alias(f"f{int(b) if float(b).is_integer() else b}")
          for b in betas])


def argmax_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """SRT-5: the cut-off with the best metric (smallest cut-off on ties)."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("threshold")).alias("t")))
    return (sweep.filter(F.col(metric).isNotNull()).agg(best.alias("_b"))
            .select((-F.col("_b.t")).alias("threshold"), F.col("_b.m").alias(metric)))


# --- cumulative counts in descending score order (WIN-1 / WIN-2) ---------------------


def cumulative_counts(scored: DataFrame, label: str = "label", score: str = "score",
                      group: Iterable[str] = (), rows_per_bucket: int = 2_000_000,
                      buckets: int | None = None, max_buckets: int = 4096) -> DataFrame:
    """WIN-1/WIN-2: per distinct score (descending, ties together) the
    cumulative positives/negatives and the previous point's values.

    Returns (group..., score, pos, neg, cum_tp, cum_fp, prev_tp, prev_fp, P, N).
    """
    group = list(group)
    y = _given(label).cast("int") == 1
    # one row per distinct score; written to the shared folder because the count, the
    # boundary sketch, the bucket totals and the windows all read it (and the scored input is
    # often a model's output, expensive to recompute); nothing stays cached
    dist = (scored.groupBy(*group, _given(score).cast("double").alias("score"))
            .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    path = scratch_path(scored.sparkSession, f"scores-{uuid.uuid4().hex}")
    dist.write.parquet(path)
    dist = scored.sparkSession.read.schema(dist.schema).parquet(path)
    if buckets is None:
        n_dist = dist.count()
        buckets = max(1, min(max_buckets, math.ceil(n_dist / rows_per_bucket)))
    wg = Window.partitionBy(*group)
    if buckets <= 1:
        # small input: one window per group over the distinct scores
        w = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        cum = (dist.withColumn("cum_tp", F.sum("pos").over(w)).withColumn("cum_fp", F.sum("neg").over(w))
               .withColumn("P", F.sum("pos").over(wg)).withColumn("N", F.sum("neg").over(wg)))
    else:
        probs = [i / buckets for i in range(1, buckets)]
        bounds = dist.agg(F.percentile_approx("score", probs, 10 * buckets)).first()[0]
        splits = sorted(set(float(b) for b in bounds))
        bz = Bucketizer(splits=[-math.inf] + splits + [math.inf], inputCol="score",
                        outputCol="_asc", handleInvalid="keep")
        dist = bz.transform(dist).withColumn(
            "bucket", (F.lit(len(splits)) - F.col("_asc")).cast("int")).drop("_asc")
        # exact totals per bucket -> exclusive offsets (a bucket-sized table)
        tot = dist.groupBy(*group, "bucket").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
        wo = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offs = (tot.withColumn("_op", F.coalesce(F.sum("_bp").over(wo), F.lit(0)))
                .withColumn("_on", F.coalesce(F.sum("_bn").over(wo), F.lit(0)))
                .withColumn("P", F.sum("_bp").over(wg)).withColumn("N", F.sum("_bn").over(wg))
                .drop("_bp", "_bn"))
        joined = join_small(dist, offs, group + ["bucket"], "inner", max_rows=1_000_000)
        w = (Window.partitionBy(*group, "bucket").orderBy(F.desc("score"))
             .rowsBetween(Window.unboundedPreceding, 0))
        cum = (joined.withColumn("cum_tp", F.col("_op") + F.sum("pos").over(w))
               .withColumn("cum_fp", F.col("_on") + F.sum("neg").over(w)))
    return cum.select(*group, "score", "pos", "neg", "cum_tp", "cum_fp",
                      (F.col("cum_tp") - F.col("pos")).alias("prev_tp"),
                      (F.col("cum_fp") - F.col("neg")).alias("prev_fp"), "P", "N")


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score",
              group: Iterable[str] = (), **kw) -> DataFrame:
    """EVA-10: (threshold, fpr, tpr) for every distinct score, plus the
    starting point (0, 0) at threshold max+1. All points are kept (no
    dropping of collinear points)."""
    group = list(group)
    cum = cumulative_counts(scored, label, score, group, **kw)
    pts = cum.select(*group, F.col("score").alias("threshold"),
                     _ratio(F.col("cum_fp"), F.col("N")).alias("fpr"),
                     _ratio(F.col("cum_tp"), F.col("P")).alias("tpr"))
    start = (cum.groupBy(*group).agg((F.max("score") + 1).alias("threshold"))
             .select(*group, "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return pts.unionByName(start)


def auc(scored: DataFrame, label: str = "label", score: str = "score",
        group: Iterable[str] = (), **kw) -> DataFrame:
    """EVA-11: trapezoid area under the ROC curve (ties handled as one
    point); one row per group."""
    group = list(group)
    cum = cumulative_counts(scored, label, score, group, **kw)
    x, xp = _ratio(F.col("cum_fp"), F.col("N")), _ratio(F.col("prev_fp"), F.col("N"))
    t, tprev = _ratio(F.col("cum_tp"), F.col("P")), _ratio(F.col("prev_tp"), F.col("P"))
    return cum.groupBy(*group).agg(F.sum((x - xp) * (t + tprev) / 2).alias("auc"))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score", **kw) -> DataFrame:
    """EVA-12: (threshold, precision, recall) per distinct score from the
    highest down to the first score reaching full recall, plus the end point
    (precision 1, recall 0, no threshold)."""
    cum = cumulative_counts(scored, label, score, **kw)
    pts = cum.filter(F.col("prev_tp") < F.col("P")).select(
        F.col("score").alias("threshold"),
        _ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        _ratio(F.col("cum_tp"), F.col("P")).alias("recall"))
    spark = scored.sparkSession
    end = spark.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return pts.unionByName(end)


def threshold_for_recall(scored: DataFrame, target: float, label: str = "label",
                         score: str = "score", **kw) -> DataFrame:
    """EVA-13: the highest cut-off whose predictions ``score >= cut-off``
    reach the target recall, with precision and fpr there."""
    cum = cumulative_counts(scored, label, score, **kw)
    rec = _ratio(F.col("cum_tp"), F.col("P"))
    # the point of the highest score, its columns with it, in one aggregation
    best = cum.filter(rec >= F.lit(float(target))).agg(F.max(F.struct("score", "cum_tp", "cum_fp", "P", "N")).alias("_b"))
    return best.filter(F.col("_b").isNotNull()).select("_b.*").select(
        F.col("score").alias("threshold"), rec.alias("recall"),
        _ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        _ratio(F.col("cum_fp"), F.col("N")).alias("fpr"))


def model_comparison(scored: DataFrame, model: str = "model", label: str = "label",
                     score: str = "score", prediction: str = "prediction", **kw) -> DataFrame:
    """EVA-14: accuracy, recall and AUC per model over a union of scored
    tables (one ``model`` column)."""
    y = _given(label).cast("int") == 1
    p = _given(prediction).cast("int") == 1
    m = scored.groupBy(model).agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        _ratio(F.count_if(y & p), F.count_if(y)).alias("recall"))
    return join_groups(m, auc(scored, label, score, [model], **kw), [model], "left")


def collapse_multiclass(df: DataFrame, class_col: str, default: Iterable[str],
                        out: str) -> DataFrame:
    """EVA-15: predicted/true class names -> binary default flag."""
    return df.withColumn(out, is_default(class_col, default))


def error_analysis(scored: DataFrame, by: str, label: str = "label",
                   prediction: str = "prediction") -> DataFrame:
    """EVA-16: errors per original class: rows, wrong rows and error rate."""
    err = _given(label).cast("int") != _given(prediction).cast("int")
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(err).alias("n_wrong"),
                                  F.avg(err.cast("double")).alias("error_rate"))


def null_classifier(df: DataFrame, label: str = "label") -> DataFrame:
    """VAL-9: accuracy and matrix of always predicting 0."""
    y = _given(label).cast("int") == 1
    return df.agg(F.avg((~y).cast("double")).alias("accuracy"),
                  F.count_if(~y).alias("tn"), F.count_if(y).alias("fn"))
