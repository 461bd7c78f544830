"""Column profiling: shape, types, missing shares, cardinality, minima,
skewness, string lengths.

Each statistic is ONE aggregation over the table with one expression per
column, followed by an unpivot of the single result row. That is one scan
whatever the number of columns (the source scanned once per column).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

from ..catalog import SENTINEL_TEXT

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """PRJ-3: the string-only or numeric-only columns."""
    cols = string_columns(df) if kind == "string" else numeric_columns(df)
    return df.select(*cols)


def _long(row_df: DataFrame, items: list, value_type: str = "double") -> DataFrame:
    """Turn a one-row aggregate into (column, ...) rows; ``items`` is a list of
    (name, {field: Column}) pairs evaluated on the aggregate row."""
    structs = []
    for name, fields in items:
        structs.append(F.struct(F.lit(name).alias("column"),
                                *[v.alias(k) for k, v in fields.items()]))
    return row_df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def row_count(df: DataFrame) -> DataFrame:
    """AGG-1: number of rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("long").alias("n_columns"))


def column_profile(df: DataFrame) -> DataFrame:
    """AGG-2: per column its type and non-missing count (one scan)."""
    cols = df.columns
    agg = df.agg(*[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _long(agg, [(c, {"dtype": F.lit(types[c]), "non_null": F.col(f"_{i}")})
                       for i, c in enumerate(cols)])


def null_fraction(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """AGG-4 + SRT-1: missing count and share of all rows per column, most
    missing first (name breaks ties)."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(cols)])
    out = _long(agg, [(c, {"n_missing": F.col(f"_{i}"), "n_rows": F.col("_n")})
                      for i, c in enumerate(cols)])
    return (out.withColumn("share", F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")))
            .drop("n_rows").orderBy(F.desc("n_missing"), F.asc("column")))


def sentinel_fraction(df: DataFrame, sentinel: str = SENTINEL_TEXT) -> DataFrame:
    """AGG-5: share of whole-cell ``sentinel`` text per string column, only
    where it occurs."""
    cols = string_columns(df)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c) == F.lit(sentinel)).alias(f"_{i}")
                   for i, c in enumerate(cols)])
    out = _long(agg, [(c, {"n_sentinel": F.col(f"_{i}"), "n_rows": F.col("_n")})
                      for i, c in enumerate(cols)])
    return (out.filter(F.col("n_sentinel") > 0)
            .withColumn("share", F.col("n_sentinel") / F.col("n_rows")).drop("n_rows"))


def _as_text(df: DataFrame, cols: list) -> DataFrame:
    """Long form (column, value as text) of ``cols``: the input of
    cardinality statistics over mixed-type columns."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols])).alias("_kv")).select("_kv.column", "_kv.value")


def distinct_values(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """AGG-6: distinct non-missing (column, value) pairs of the given columns
    (default: every string column). Map-side de-duplication, one shuffle."""
    cols = list(cols or string_columns(df))
    return _as_text(df, cols).filter(F.col("value").isNotNull()).distinct()


def distinct_count(df: DataFrame, cols: Iterable[str] | None = None,
                   approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """AGG-7 + SRT-1: distinct values per column, missing counted as one more
    value (pandas ``unique`` convention), share of rows, most distinct first.

    ``approx=True`` uses HyperLogLog++ (one algebraic pass, no shuffle of the
    values) -- the choice for very wide or very large tables.
    """
    cols = list(cols or df.columns)
    if approx:
        agg = df.agg(F.count(F.lit(1)).alias("_n"), *[
            (F.approx_count_distinct(c, rsd) + F.max(F.col(c).isNull()).cast("long")).alias(f"_{i}")
            for i, c in enumerate(cols)])
        out = _long(agg, [(c, {"n_distinct": F.col(f"_{i}"), "n_rows": F.col("_n")})
                          for i, c in enumerate(cols)])
    else:
        n = df.agg(F.count(F.lit(1))).scalar()
        kv = _as_text(df, cols)
        # distinct (column, value) pairs, de-duplicated map-side, then counted
        out = (kv.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
               .withColumn("n_rows", n))
    return (out.withColumn("ratio", F.col("n_distinct") / F.col("n_rows")).drop("n_rows")
            .orderBy(F.desc("n_distinct"), F.asc("column")))


def column_min(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """AGG-20: per numeric column the minimum (to choose a missing sentinel
    below every real value)."""
    cols = list(cols or numeric_columns(df))
    agg = df.agg(*[F.min(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)])
    return _long(agg, [(c, {"min": F.col(f"_{i}")}) for i, c in enumerate(cols)])


def column_skewness(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """AGG-21 + SRT-1: population skewness (third central moment over the 1.5th
    power of the second, missing omitted), most skewed first. Algebraic: one
    pass, partial aggregation."""
    cols = list(cols or numeric_columns(df))
    agg = df.agg(*[F.skewness(F.col(c).cast("double")).alias(f"_{i}") for i, c in enumerate(cols)])
    out = _long(agg, [(c, {"skewness": F.col(f"_{i}")}) for i, c in enumerate(cols)])
    return out.orderBy(F.desc_nulls_last("skewness"), F.asc("column"))


def length_set(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """AGG-24: the set of string lengths per column."""
    return (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.length(c).alias("length")) for c in cols]))
        .alias("_s")).select("_s.*").filter(F.col("length").isNotNull()).distinct())


def all_rows(df: DataFrame, predicates: dict) -> DataFrame:
    """PRD-5: does each named predicate hold on every row (NULL rows skipped)."""
    return df.agg(*[F.coalesce(F.bool_and(p), F.lit(True)).alias(name)
                    for name, p in predicates.items()])


def head(df: DataFrame, n: int = 5, order_by: str = "id") -> DataFrame:
    """SRT-2: the first ``n`` rows under an explicit order."""
    return df.orderBy(order_by).limit(n)


def head_most_distinct(df: DataFrame, k: int = 5, n: int = 5, order_by: str = "id",
                       cols: Iterable[str] | None = None) -> DataFrame:
    """SRT-3: the first ``n`` rows of the ``k`` most distinct columns, long form
    (rank, column, row, value). Only the k names (bounded) reach the driver."""
    ranked = distinct_count(df, [c for c in (cols or df.columns) if c != order_by])
    names = [r["column"] for r in ranked.limit(k).collect()]
    top = df.orderBy(order_by).limit(n)
    items = [F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("column"),
                      F.col(order_by).alias("row_id"), F.col(c).cast("string").alias("value"))
             for i, c in enumerate(names)]
    return top.select(F.explode(F.array(*items)).alias("_s")).select("_s.*")
