"""Scalar column expressions.

All are built-in Spark expressions, so they stay inside whole-stage codegen;
no Python UDF is used anywhere in this module.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

__all__ = [
    "col_of", "str_length", "last_two", "clean_name", "shorten", "first_char",
    "sub_grade_ordinal", "parse_month", "date_to_ns", "month_end",
    "log1p", "log_shift", "pct_round", "safe_ratio", "negative_to",
    "is_default", "binary_label", "status_class", "value_map", "null_sentinel",
    "NS_PER_DAY",
]

NS_PER_DAY = 86_400_000_000_000


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- strings ---------------------------------------------------------------

def str_length(c) -> Column:
    """STR-1: number of characters."""
    return F.length(col_of(c))


def last_two(c) -> Column:
    """STR-2: the last two characters (regex ``..$``; empty if shorter)."""
    return F.regexp_extract(col_of(c), "..$", 0)


def clean_name(c, replacement: str = "-") -> Column:
    """STR-3: replace ``[``, ``]`` and ``<`` (characters some learners refuse in
    feature names) by ``replacement``."""
    return F.regexp_replace(col_of(c), r"[\[\]<]", replacement)


def shorten(c, limit: int = 22, head: int = 6, tail: int = 11) -> Column:
    """STR-4: names longer than ``limit`` become first ``head`` + '..' + last
    ``tail`` characters."""
    x = col_of(c)
    return F.when(F.length(x) > limit,
                  F.concat(F.substring(x, 1, head), F.lit(".."), F.right(x, F.lit(tail)))
                  ).otherwise(x)


def first_char(c) -> Column:
    """STR-5."""
    return F.substring(col_of(c), 1, 1)


def sub_grade_ordinal(c) -> Column:
    """STR-6: 'A1'..'G5' -> 1..35, i.e. (letter - 'A') * 5 + digit."""
    x = col_of(c)
    return (F.ascii(F.substring(x, 1, 1)) - 65) * 5 + F.substring(x, 2, 1).cast("int")


# --- dates -----------------------------------------------------------------

def parse_month(c, fmt: str = "MMM-yyyy") -> Column:
    """DAT-1: 'Mon-YYYY' text -> first day of that month; unparsable -> NULL."""
    return F.try_to_date(col_of(c), fmt)


def date_to_ns(d, sentinel: float | int = -99, pre_epoch: str = "sentinel") -> Column:
    """DAT-2: date -> nanoseconds since 1970-01-01 (int64).

    Missing dates become ``sentinel``; dates before 1970 also do unless
    ``pre_epoch='keep'``.
    """
    ud = F.unix_date(col_of(d)).cast("long")
    ns = ud * F.lit(NS_PER_DAY)
    if pre_epoch == "keep":
        return F.coalesce(ns, F.lit(sentinel).cast("long"))
    return F.coalesce(F.when(ud < 0, F.lit(sentinel).cast("long")).otherwise(ns),
                      F.lit(sentinel).cast("long"))


def month_end(d) -> Column:
    """DAT-3: month-end bucket of a date."""
    return F.last_day(col_of(d))


# --- maths -----------------------------------------------------------------

def log1p(c) -> Column:
    """MTH-1."""
    return F.log1p(col_of(c))


def log_shift(c, shift: float = 10.0) -> Column:
    """MTH-2: ln(x + shift); NULL outside the domain (x <= -shift)."""
    x = col_of(c)
    return F.when(x + F.lit(shift) > 0, F.ln(x + F.lit(shift)))


def pct_round(x, n, digits: int = 1) -> Column:
    """MTH-3: round(100 * x / n, digits); NULL when n is 0."""
    return F.round(F.try_divide(F.lit(100.0) * col_of(x), col_of(n).cast("double")), digits)


def safe_ratio(x, n) -> Column:
    """MTH-4: x / n as double, 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(col_of(x).cast("double"), col_of(n).cast("double")),
                      F.lit(0.0))


def negative_to(c, value=-99) -> Column:
    """MTH-6: values below zero replaced by ``value``."""
    x = col_of(c)
    return F.when(x < 0, F.lit(value)).otherwise(x)


# --- status predicates -------------------------------------------------------

def is_default(status, default: Iterable[str]) -> Column:
    """PRD-1: 1 if the status is a default status, else 0 (missing -> 0)."""
    return F.when(col_of(status).isin(list(default)), F.lit(1)).otherwise(F.lit(0))


def binary_label(status, default: Iterable[str]) -> Column:
    """PRD-2: 'Default' / 'Non-default'."""
    return F.when(col_of(status).isin(list(default)), F.lit("Default")).otherwise(
        F.lit("Non-default"))


def status_class(status, taxonomy) -> Column:
    """PRD-4: 'default' / 'repaid' / 'current' (NULL for unknown)."""
    s = col_of(status)
    return (F.when(s.isin(list(taxonomy.default)), F.lit("default"))
            .when(s.isin(list(taxonomy.repaid)), F.lit("repaid"))
            .when(s.isin(list(taxonomy.current)), F.lit("current")))


def value_map(c, mapping: dict) -> Column:
    """PRD-3: dictionary lookup of a value; unmapped -> NULL."""
    x = col_of(c)
    out = None
    for k, v in mapping.items():
        out = (F.when(x == F.lit(k), F.lit(v)) if out is None
               else out.when(x == F.lit(k), F.lit(v)))
    return out if out is not None else F.lit(None)


def null_sentinel(c, sentinel: str = "n/a") -> Column:
    """SRC-2 on one column: the whole-cell sentinel text becomes NULL."""
    return F.nullif(col_of(c), F.lit(sentinel))
