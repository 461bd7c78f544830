"""Exploration: filters, group and time aggregations, plot data.

Every aggregation is one pass with partial (map-side) aggregation: e.g. the
per-status monthly series is ONE ``groupBy(status, month)``, not one scan per
status. Missing group keys are filtered out first (pandas grouping skips them,
Spark keeps a NULL group).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import (col_of, is_default, log1p, month_end, parse_month)

# --- filters ---------------------------------------------------------------


def filter_status_in(df: DataFrame, statuses: Iterable[str], col: str = "loan_status") -> DataFrame:
    """FLT-1: keep rows whose status is in ``statuses`` (pushed to the scan
    when ``col`` is a stored column)."""
    return df.filter(F.col(col).isin(list(statuses)))


def filter_eq(df: DataFrame, col: str, value) -> DataFrame:
    """FLT-2."""
    return df.filter(F.col(col) == F.lit(value))


def leak_check(df: DataFrame, col: str, label: str = "loan_status") -> DataFrame:
    """FLT-3: label values seen where a post-outcome amount is positive."""
    return df.filter(F.col(col) > 0).select(label).distinct()


def drop_missing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """FLT-4: rows where all ``cols`` are present."""
    return df.dropna(subset=list(cols))


def filter_since(df: DataFrame, date_col, since: str) -> DataFrame:
    """FLT-5: rows on or after a date literal (``date_col`` text or date)."""
    return df.filter(col_of(date_col) >= F.to_date(F.lit(since)))


def since_counts(df: DataFrame, date_col, since: str) -> DataFrame:
    """FLT-5: True/False counts of the time restriction (missing dates skipped)."""
    d = col_of(date_col)
    return (df.filter(d.isNotNull())
            .groupBy((d >= F.to_date(F.lit(since))).alias("since"))
            .agg(F.count(F.lit(1)).alias("n")))


def error_rows(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """FLT-6: rows where the prediction differs from the label."""
    return scored.filter(F.col(label) != F.col(prediction))


def correct_rows(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """FLT-6: rows where the prediction equals the label."""
    return scored.filter(F.col(label) == F.col(prediction))


def error_counts(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """FLT-6: correct and wrong row counts in one pass."""
    ok = F.col(label) == F.col(prediction)
    return scored.agg(F.count_if(ok).alias("n_correct"), F.count_if(~ok).alias("n_wrong"))


# --- group aggregations --------------------------------------------------------


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """AGG-8: frequency per non-missing value, most frequent first."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col)
            .agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), F.asc(col)))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """AGG-9 / WIN-4: share of each value among non-missing values.

    The total is a scalar subquery (one partial-aggregated pass), so no
    window ever holds all distinct values of a high-cardinality column.
    """
    base = df.filter(F.col(col).isNotNull())
    vc = base.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return vc.withColumn("share", F.col("n") / base.agg(F.count(F.lit(1))).scalar())


def group_size(df: DataFrame, col: str) -> DataFrame:
    """AGG-10: rows per non-missing key."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def group_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-11: sum of ``value`` per non-missing key."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum(value).alias(f"sum_{value}")))


def group_sum_by_date(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """AGG-12: sum per exact (parsed) date."""
    d = parse_month(date_col)
    return (df.filter(d.isNotNull()).groupBy(d.alias("date"))
            .agg(F.sum(value).alias(f"sum_{value}")))


def monthly(df: DataFrame, date_col: str, value: str) -> DataFrame:
    """AGG-13/14/15 (and JN-2): per month-end bucket, the sum, the count of
    non-missing values and their ratio, in one aggregation."""
    m = month_end(parse_month(date_col))
    return (df.filter(m.isNotNull()).groupBy(m.alias("month"))
            .agg(F.sum(value).alias("total"), F.count(value).alias("n"))
            .withColumn("avg", F.try_divide(F.col("total"), F.col("n"))))


def monthly_count_by_status(df: DataFrame, date_col: str, default: Iterable[str],
                            status: str = "loan_status") -> DataFrame:
    """AGG-16/17, PLT-6: loans per (status, month), log1p of the count and the
    default flag of the status; one shuffle on (status, month)."""
    m = month_end(parse_month(date_col))
    return (df.filter(m.isNotNull() & F.col(status).isNotNull())
            .groupBy(F.col(status), m.alias("month"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("log_n", log1p("n"))
            .withColumn("is_default", is_default(status, default)))


def month_calendar_fill(counts: DataFrame, keys: list, month: str = "month",
                        value: str = "n") -> DataFrame:
    """AGG-18: every month between each key's first and last month, empty
    months counted 0.

    The calendar is generated per key from its (min, max) range with
    ``sequence`` -- no cross join; its size is the number of months spanned.
    """
    rng = counts.groupBy(*keys).agg(F.trunc(F.min(month), "month").alias("_lo"),
                                    F.trunc(F.max(month), "month").alias("_hi"))
    cal = rng.select(*keys, F.explode(
        F.sequence(F.col("_lo"), F.col("_hi"), F.expr("interval 1 month"))).alias(month))
    cal = cal.withColumn(month, F.last_day(month))
    return (cal.join(counts.select(*keys, month, value), keys + [month], "left")
            .withColumn(value, F.coalesce(F.col(value), F.lit(0)).cast("long")))


def date_value_counts(df: DataFrame, date_cols: list) -> DataFrame:
    """AGG-19: counts per parsed date value for several date columns in one
    pass (unpivot, then one groupBy)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), parse_month(c).alias("date")) for c in date_cols
    ])).alias("kv")).select("kv.column", "kv.date")
    return (long.filter(F.col("date").isNotNull()).groupBy("column", "date")
            .agg(F.count(F.lit(1)).alias("n")))


def counts_of_counts(df: DataFrame, status: str, default: Iterable[str]) -> DataFrame:
    """AGG-22: the per-status count table grouped again by the default flag:
    number of statuses and number of loans per flag."""
    vc = group_size(df, status).withColumn("is_default", is_default(status, default))
    return vc.groupBy("is_default").agg(F.count(F.lit(1)).alias("n_statuses"),
                                        F.sum("n").alias("n_loans"))


def bincount(df: DataFrame, col: str) -> DataFrame:
    """AGG-23: histogram of a non-negative integer column over 0..max, with
    zeros for absent values (calendar-style fill, no cross join). A negative
    value is refused with an error."""
    x = F.col(col).cast("long")
    x = F.when(x < 0, F.raise_error(F.lit(f"bincount: {col} holds a negative value"))).otherwise(x)
    counts = df.filter(F.col(col).isNotNull()).groupBy(x.alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    rng = counts.agg(F.max("value").alias("_hi")).filter(F.col("_hi").isNotNull())
    cal = rng.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_hi"))).alias("value"))
    return (cal.join(counts, "value", "left")
            .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long")))


# --- plot data ----------------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = None) -> DataFrame:
    """PLT-1: equal-width histogram between the column's min and max; the
    last bin is closed. Optional per-group histograms (same edges).

    The global min/max come from one aggregation (two scalars to the driver).
    """
    x = F.col(col)
    base = df.filter(x.isNotNull())
    mm = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = F.lit(mm["lo"]), F.lit(mm["hi"])
    w = (hi - lo) / F.lit(float(bins))
    b = F.when(w > 0, F.least(F.floor((x - lo) / w), F.lit(bins - 1))
               ).otherwise(F.lit(0)).cast("int")
    keys = [F.col(by)] if by else []
    counts = base.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, "bin", (lo + F.col("bin") * w).alias("lo"),
                         (lo + (F.col("bin") + 1) * w).alias("hi"), "n")


def status_bars(df: DataFrame, status: str, value: str, default: Iterable[str]) -> DataFrame:
    """PLT-5: per status, count and summed amount with their log1p and the
    default flag (the bar heights and colours of the status figure)."""
    return (df.filter(F.col(status).isNotNull()).groupBy(status)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .withColumn("log_n", log1p("n"))
            .withColumn("log_total", log1p("total"))
            .withColumn("is_default", is_default(status, default)))


def status_shares(df: DataFrame, status: str) -> DataFrame:
    """PLT-4: status counts with their percentage of all rows (missing included
    in the denominator)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return group_size(df, status).select(
        status, "n", F.round(F.lit(100.0) * F.col("n") / total, 1).alias("pct"))
