"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = 100_000) -> DataFrame:
    """Join ``small`` to ``big``, broadcasting ``small`` only behind a size check.

    ``small`` is expected to be an aggregate (one row per group). Its row count
    is measured first; only when it is at most ``max_rows`` is it broadcast,
    otherwise the join is left to Catalyst/AQE (sort-merge with skew splitting).
    """
    small = small.cache()  # counted once, then reused by the join (no second pass)
    n = small.count()
    if n > max_rows:
        small.unpersist()
    return join_groups(big, F.broadcast(small) if n <= max_rows else small, on, how)


def join_groups(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join on group keys of which any may be NULL: a NULL group is a group
    like any other, as in ``groupBy``; the keys come from the left side."""
    keys = [on] if isinstance(on, str) else list(on)
    names = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    cond = None
    for k, name in names.items():
        same = left[k].eqNullSafe(right[name])
        cond = same if cond is None else cond & same
    return left.join(right, cond, how).drop(*names.values())
