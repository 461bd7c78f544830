"""Feature preparation.

``transform_predictors`` turns any column subset of the loan table into model
input: dates -> int64 nanoseconds (missing/pre-1970 -> sentinel), categories
-> one indicator per observed value (missing -> all zeros), sub-grade ->
ordinal, numerics as is, remaining missing -> sentinel. Groups enter in
sorted order: dates, indicators, ordinal, numerics.

Two forms:

* the **vector form** is a ``pyspark.ml.Pipeline`` of standard stages
  (SQLTransformer, StringIndexer, OneHotEncoder, VectorAssembler), so the
  data-dependent width lives inside one sparse vector and the fitted
  pipeline persists with ``save``/``load``;
* the **long form** ``(id, feature, value)`` lists every non-indicator
  feature and every indicator that is 1 -- the sparse vector's entries as
  rows, checkable with SQL.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.feature import (IndexToString, OneHotEncoder, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.sql import DataFrame, functions as F

from ..catalog import MISSING_FILL, FeatureCatalog
from ..functions.expr import date_to_ns, log_shift, parse_month, sub_grade_ordinal
from ._util import join_small


def assemble_columns(parts: list, on: str = "id") -> DataFrame:
    """JN-1: column groups computed as separate tables, aligned on the row id
    (inner equi-joins). When the groups come from one table, compute them in
    one ``select`` instead (no join at all) -- see ``transform_predictors``."""
    return reduce(lambda a, b: a.join(b, on, "inner"), parts)


# --- groups -------------------------------------------------------------------------


def feature_groups(columns, catalog: FeatureCatalog) -> dict:
    cols = list(columns)
    return {
        "date": catalog.present("date", cols),
        "dummy": catalog.present("dummy", cols),
        "calculate": catalog.present("calculate", cols),
        "numeric": catalog.numeric(cols),
    }


def _date_sql(c: str, sentinel: float, pre_epoch: str) -> str:
    ud = f"unix_date(try_to_date(`{c}`, 'MMM-yyyy'))"
    s = int(sentinel)
    if pre_epoch == "keep":
        return f"coalesce(CAST({ud} AS BIGINT) * 86400000000000L, {s}L)"
    if -86_400_000_000_000 <= s <= 0:  # not above any day before 1970: one parse of the text instead of two
        return f"greatest(coalesce(CAST({ud} AS BIGINT) * 86400000000000L, {s}L), {s}L)"
    return (f"coalesce(CASE WHEN {ud} < 0 THEN {s}L ELSE CAST({ud} AS BIGINT) * 86400000000000L END, {s}L)")


# --- long (flat) form ---------------------------------------------------------------


def predictors_long(df: DataFrame, catalog: FeatureCatalog, id_col: str = "id",
                    sentinel: float = MISSING_FILL, pre_epoch: str = "sentinel") -> DataFrame:
    """FEA-1 (flat): (id, feature, value) for every date, ordinal and numeric
    feature and for every indicator equal to 1 (name ``column_value``)."""
    g = feature_groups([c for c in df.columns if c != id_col], catalog)
    items = []
    for c in g["date"]:
        items.append(F.struct(F.lit(c).alias("feature"),
                              date_to_ns(parse_month(c), sentinel, pre_epoch).cast("double").alias("value")))
    for c in g["dummy"]:
        items.append(F.struct(F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "_"), F.col(c))).alias("feature"),
                              F.lit(1.0).alias("value")))
    for c in g["calculate"]:
        items.append(F.struct(F.lit(c).alias("feature"),
                              F.coalesce(sub_grade_ordinal(c).cast("double"), F.lit(sentinel)).alias("value")))
    for c in g["numeric"]:
        items.append(F.struct(F.lit(c).alias("feature"),
                              F.coalesce(F.col(c).cast("double"), F.lit(sentinel)).alias("value")))
    return (df.select(F.col(id_col), F.explode(F.array(*items)).alias("_f"))
            .select(id_col, "_f.feature", "_f.value").filter(F.col("feature").isNotNull()))


def one_hot_long(df: DataFrame, cols: Iterable[str], id_col: str = "id") -> DataFrame:
    """FEA-2 (flat): (id, feature) of the indicators equal to 1."""
    items = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "_"), F.col(c))) for c in cols]
    return (df.select(id_col, F.explode(F.array(*items)).alias("feature"))
            .filter(F.col("feature").isNotNull()))


# --- vector form -------------------------------------------------------------------


class DropColumns(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage removing intermediate columns (persists with the pipeline)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getInputCols())



def feature_pipeline(columns, catalog: FeatureCatalog, sentinel: float = MISSING_FILL,
                     pre_epoch: str = "sentinel", output: str = "features",
                     max_categories: int | None = None) -> Pipeline:
    """FEA-1 (vector): the encoding as a Spark ML pipeline.

    The indexers learn each category column's values (alphabetical, a bounded
    list per column); NULL/unseen values get the extra last index, which the
    encoder drops (``dropLast``) -> all-zero indicators, as the reference's
    encoding does. The encoder must not add its own invalid slot.
    """
    g = feature_groups(columns, catalog)
    sel = ["*"]
    for c in g["date"]:
        sel.append(f"CAST({_date_sql(c, sentinel, pre_epoch)} AS DOUBLE) AS `__d_{c}`")
    for c in g["calculate"]:
        sel.append(f"coalesce(CAST((ascii(substr(`{c}`, 1, 1)) - 65) * 5 + CAST(substr(`{c}`, 2, 1) AS INT) "
                   f"AS DOUBLE), {float(sentinel)}D) AS `__c_{c}`")
    for c in g["numeric"]:
        sel.append(f"coalesce(CAST(`{c}` AS DOUBLE), {float(sentinel)}D) AS `__n_{c}`")
    stages = [SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__")]
    if g["dummy"]:
        stages.append(StringIndexer(inputCols=g["dummy"], outputCols=[f"__i_{c}" for c in g["dummy"]],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"__i_{c}" for c in g["dummy"]],
                                    outputCols=[f"__v_{c}" for c in g["dummy"]],
                                    dropLast=True, handleInvalid="error"))
    inputs = ([f"__d_{c}" for c in g["date"]] + [f"__v_{c}" for c in g["dummy"]]
              + [f"__c_{c}" for c in g["calculate"]] + [f"__n_{c}" for c in g["numeric"]])
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep"))
    temp = (["__d_" + c for c in g["date"]] + ["__i_" + c for c in g["dummy"]]
            + ["__v_" + c for c in g["dummy"]] + ["__c_" + c for c in g["calculate"]]
            + ["__n_" + c for c in g["numeric"]])
    stages.append(DropColumns(inputCols=temp))
    return Pipeline(stages=stages)


def feature_names(model, columns, catalog: FeatureCatalog) -> list:
    """Names of the vector slots of a fitted ``feature_pipeline``: the
    reference's column names, ``column_value`` for indicators."""
    g = feature_groups(columns, catalog)
    names = list(g["date"])
    if g["dummy"]:
        idx = [s for s in model.stages if hasattr(s, "labelsArray")][0]
        for c, labels in zip(g["dummy"], idx.labelsArray):
            names += [f"{c}_{v}" for v in labels]
    return names + list(g["calculate"]) + list(g["numeric"])


def vector_long(df: DataFrame, names: list, vec: str = "features", id_col: str = "id") -> DataFrame:
    """Non-zero vector slots as (id, feature, value) rows -- used to check the
    vector form against the flat form. ``names`` is a bounded list."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(vec))
    name_arr = F.array(*[F.lit(n) for n in names])
    return (df.select(id_col, F.posexplode(arr).alias("_i", "value"))
            .select(id_col, F.element_at(name_arr, F.col("_i") + 1).alias("feature"), "value"))


# --- labels ------------------------------------------------------------------------


def label_indexer(label: str = "loan_status", out: str = "label_idx") -> StringIndexer:
    """FEA-3: label -> 0..k-1 in alphabetical order."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")


def make_multiclass(df: DataFrame, label: str = "loan_status", idx: str = "label_idx",
                    vec: str = "label_vec"):
    """FEA-4: label -> index and one-hot vector; returns (frame, fitted indexer)
    so predictions can be decoded by name (``decode_labels``)."""
    im = label_indexer(label, idx).fit(df)
    enc = OneHotEncoder(inputCols=[idx], outputCols=[vec], dropLast=False).fit(im.transform(df))
    return enc.transform(im.transform(df)), im


def decode_labels(df: DataFrame, indexer_model, idx: str, out: str) -> DataFrame:
    """Inverse of FEA-3/4: index -> label name."""
    return IndexToString(inputCol=idx, outputCol=out, labels=indexer_model.labels).transform(df)


# --- scaling and transforms ------------------------------------------------------------


def standardize(df: DataFrame, cols: list, fit_df: DataFrame | None = None) -> DataFrame:
    """FEA-5: (x - mean) / population std, moments from ``fit_df`` (e.g. the
    training rows) applied to ``df``; one aggregation, 2 x len(cols) scalars."""
    src = fit_df if fit_df is not None else df
    m = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        mu, sd = m[f"m{i}"], m[f"s{i}"]
        out[c] = ((F.col(c).cast("double") - F.lit(mu)) / F.lit(sd)) if sd else F.lit(0.0)
    return df.withColumns(out)


def row_normalize(df: DataFrame, cols: list) -> DataFrame:
    """FEA-6: divide each row's values by the row's L2 norm (0 stays 0)."""
    norm = F.sqrt(reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) ** 2 for c in cols]))
    return df.withColumns({c: F.when(norm > 0, F.col(c).cast("double") / norm).otherwise(F.lit(0.0)) for c in cols})


def skewed_columns(df: DataFrame, cols: list, min_skew: float = 1.0) -> list:
    """Columns whose population skewness is at least ``min_skew`` (one pass;
    the names, a bounded list, come to the driver)."""
    row = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"k{i}"] is not None and row[f"k{i}"] >= min_skew]


def log_skewed(df: DataFrame, cols: list, min_skew: float = 1.0, fit_df: DataFrame | None = None,
               shift: float = 10.0):
    """FEA-7: ln(x + shift) of the columns with skewness >= ``min_skew``
    (the originals replaced). Returns (frame, transformed column names)."""
    chosen = skewed_columns(fit_df if fit_df is not None else df, cols, min_skew)
    return df.withColumns({c: log_shift(c, shift) for c in chosen}), chosen


def chi2_scores(df: DataFrame, label: str, cols: list) -> DataFrame:
    """FEA-8: chi-square of class-wise feature *sums* against the class share
    of the total sum, per feature, best first.

    One aggregation grouped by class (k rows), then arithmetic on that tiny
    table. Features must be non-negative; a negative value is refused.
    """
    agg = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("_nc"),
        *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.min(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    mins = agg.agg(*[F.min(f"m{i}").alias(f"m{i}") for i in range(len(cols))]).first()
    neg = [c for i, c in enumerate(cols) if mins[f"m{i}"] is not None and mins[f"m{i}"] < 0]
    if neg:
        raise ValueError(f"chi2 needs non-negative features; negative values in {neg}")
    long = agg.select(label, "_nc", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("obs"))
        for i, c in enumerate(cols)])).alias("_s")).select(label, "_nc", "_s.*")
    from pyspark.sql import Window
    wf = Window.partitionBy("feature")
    exp = (F.col("_nc") / F.sum("_nc").over(wf)) * F.sum("obs").over(wf)
    terms = long.withColumn("_e", exp).withColumn(
        "_t", F.when(F.col("_e") > 0, (F.col("obs") - F.col("_e")) ** 2 / F.col("_e")).otherwise(F.lit(0.0)))
    return terms.groupBy("feature").agg(F.sum("_t").alias("chi2")).orderBy(F.desc("chi2"), "feature")


def select_k_best(scores: DataFrame, k: int, metric: str = "chi2") -> list:
    """Names of the k best features (bounded list to the driver)."""
    return [r["feature"] for r in scores.orderBy(F.desc(metric), "feature").limit(k).collect()]


def sample_weight(df: DataFrame, label: str = "label", weight: float = 5.0, out: str = "weight") -> DataFrame:
    """FEA-10: weight ``weight`` for positives, 1 otherwise."""
    return df.withColumn(out, F.when(F.col(label).cast("int") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))


def class_weights(df: DataFrame, label: str, weights: dict, default: float = 1.0,
                  out: str = "weight") -> DataFrame:
    """FEA-11: per-class weights from a dimension table (class -> weight)."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], f"{label} string, {out} double")
    return (join_small(df, dim, label, "left", max_rows=100_000)
            .withColumn(out, F.coalesce(F.col(out), F.lit(float(default)))))
