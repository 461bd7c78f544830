"""Registry of named queries.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql)``.
The oracle statement is DuckDB SQL over the base tables, starting with the
loan-view CTE; ``None`` marks operators that SQL cannot express (models).
Measures are rounded to 6 decimals on both sides (last-digit differences
between engines), counts are bigint on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.fixture import ORACLE_CTE, loans_view

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def oracle(body: str, extra: str = "") -> str:
    """DuckDB statement: the loan-view CTE, optional extra CTEs (starting
    with a comma), then the body."""
    return f"{ORACLE_CTE}{extra}\n{body}"


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines differ in the last digits)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


_STORED: dict = {}


def use_stored_loans(sf_dir: str, path: str | None) -> None:
    """Serve the loan view of ``sf_dir`` from a Parquet table written from
    it (``store_loans``), as a user keeps the converted loan table (SRC-1)."""
    if path is None:
        _STORED.pop(sf_dir, None)
    else:
        _STORED[sf_dir] = path


def store_loans(spark, sf_dir: str, path: str) -> str:
    """Write the loan view once to ``path`` (in the shared checkpoint folder)."""
    loans_view(spark, sf_dir).write.mode("overwrite").parquet(path)
    use_stored_loans(sf_dir, path)
    return path


def loans(spark, sf_dir: str) -> DataFrame:
    p = _STORED.get(sf_dir)
    return spark.read.parquet(p) if p else loans_view(spark, sf_dir)


def all_queries() -> dict:
    from . import q_explore, q_eval, q_features, q_models  # noqa: F401  (registration)
    return REGISTRY
