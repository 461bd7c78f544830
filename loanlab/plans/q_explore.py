"""Registered queries: sources, projections, filters, predicates, joins,
aggregations, profiling, scalar functions, plot data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import catalog
from ..functions import expr as X
from ..operators import explore as E, profile as P, split as S
from ..sources.fixture import FIXTURE_STATUSES, LOAN_COLUMNS
from ..session import scratch_path
from ..sources.loans import load_loans, null_sentinel
from .registry import loans, oracle, query, rnd

DEFAULT = list(FIXTURE_STATUSES.default)
CLOSED = list(FIXTURE_STATUSES.closed)


def _sqlist(xs):
    return "(" + ",".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


DEF_SQL = _sqlist(DEFAULT)
CLOSED_SQL = _sqlist(CLOSED)
DATE_COLS = ["earliest_cr_line", "issue_d", "last_pymnt_d"]
DOUBLES = {"loan_amnt", "annual_inc", "total_acc", "dti", "recoveries", "score"}
STRINGS = ["loan_status", "emp_length", "sub_grade", "term", "home_ownership",
           "addr_state", "issue_d", "last_pymnt_d", "earliest_cr_line"]
NUMERICS = ["id", "loan_amnt", "annual_inc", "open_acc", "total_acc", "dti", "recoveries", "score"]


def PM(c):
    """DuckDB text of DAT-1."""
    return f"CAST(try_strptime({c}, '%b-%Y') AS DATE)"


def _sel(cols, src="loans", where=""):
    parts = [f"round({c}, 6) AS {c}" if c in DOUBLES else c for c in cols]
    return f"SELECT {', '.join(parts)} FROM {src} {where}"


def clean(spark, sf):
    return null_sentinel(loans(spark, sf))


CLEAN_CTE = ", clean AS (SELECT * REPLACE (nullif(emp_length, 'n/a') AS emp_length) FROM loans)"

# --- sources / sinks ---------------------------------------------------------------


@query("load_loans", oracle(_sel(LOAN_COLUMNS)))
def q_load_loans(spark, sf):
    """The loan table written as CSV, columns in another order, and read back by header names."""
    given = loans(spark, sf)
    path = scratch_path(spark, f"loan-csv-{uuid.uuid4().hex}")
    given.select(*reversed(given.columns)).write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rnd(load_loans(spark, path, given.schema))


@query("null_sentinel", oracle(
    "SELECT id, " + ", ".join(f"nullif({c}, 'n/a') AS {c}" for c in STRINGS) + " FROM loans"))
def q_null_sentinel(spark, sf):
    return clean(spark, sf).select("id", *STRINGS)


# --- projections / filters / predicates -------------------------------------------------


@query("drop_columns", oracle(_sel([c for c in LOAN_COLUMNS if c not in catalog.DROP])))
def q_drop_columns(spark, sf):
    return rnd(loans(spark, sf).drop(*catalog.DROP))


_APP = [c for c in LOAN_COLUMNS if c in catalog.APPLICATION] + catalog.RESPONSE


@query("select_columns", oracle(_sel(_APP)))
def q_select_columns(spark, sf):
    df = loans(spark, sf)
    return rnd(df.select(*[c for c in catalog.APPLICATION + catalog.RESPONSE if c in df.columns]))


@query("select_by_type", oracle(_sel(STRINGS)))
def q_select_by_type(spark, sf):
    return P.select_by_type(loans(spark, sf), "string")


@query("filter_status_in", oracle(f"SELECT id, loan_status FROM loans WHERE loan_status IN {CLOSED_SQL}"))
def q_filter_status_in(spark, sf):
    return E.filter_status_in(loans(spark, sf), CLOSED).select("id", "loan_status")


@query("filter_eq", oracle("SELECT id, round(loan_amnt, 6) AS loan_amnt FROM loans WHERE loan_status = 'F/1-URGENT'"))
def q_filter_eq(spark, sf):
    return rnd(E.filter_eq(loans(spark, sf), "loan_status", "F/1-URGENT").select("id", "loan_amnt"))


@query("leak_check", oracle("SELECT DISTINCT loan_status FROM loans WHERE recoveries > 0"))
def q_leak_check(spark, sf):
    return E.leak_check(loans(spark, sf), "recoveries")


@query("drop_missing", oracle(
    "SELECT id, earliest_cr_line, issue_d, last_pymnt_d FROM clean "
    "WHERE earliest_cr_line IS NOT NULL AND issue_d IS NOT NULL AND last_pymnt_d IS NOT NULL", CLEAN_CTE))
def q_drop_missing(spark, sf):
    return E.drop_missing(clean(spark, sf), DATE_COLS).select("id", *DATE_COLS)


@query("filter_since", oracle(
    f"SELECT id, {PM('issue_d')} AS issue_date FROM loans WHERE {PM('issue_d')} >= DATE '1998-01-01'"))
def q_filter_since(spark, sf):
    df = loans(spark, sf).select("id", X.parse_month("issue_d").alias("issue_date"))
    return E.filter_since(df, "issue_date", "1998-01-01")


@query("since_counts", oracle(
    f"SELECT {PM('issue_d')} >= DATE '1998-01-01' AS since, count(*) AS n FROM loans "
    f"WHERE {PM('issue_d')} IS NOT NULL GROUP BY 1"))
def q_since_counts(spark, sf):
    return E.since_counts(loans(spark, sf), X.parse_month("issue_d"), "1998-01-01")


def scored_fixture(spark, sf, cutoff=0.5):
    """The view as a scored table: label = default flag, prediction = score > cut-off."""
    df = loans(spark, sf)
    return df.select("id", "loan_status", X.is_default("loan_status", DEFAULT).alias("label"),
                     "score", (F.col("score") > F.lit(cutoff)).cast("int").alias("prediction"))


SCORED_CTE = (f", scored AS (SELECT id, loan_status, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS label, "
              "score, CAST(score > 0.5 AS INTEGER) AS prediction FROM loans)")


@query("error_rows", oracle("SELECT id, label, prediction FROM scored WHERE label <> prediction", SCORED_CTE))
def q_error_rows(spark, sf):
    return E.error_rows(scored_fixture(spark, sf)).select("id", "label", "prediction")


@query("correct_rows", oracle("SELECT id, label, prediction FROM scored WHERE label = prediction", SCORED_CTE))
def q_correct_rows(spark, sf):
    return E.correct_rows(scored_fixture(spark, sf)).select("id", "label", "prediction")


@query("error_counts", oracle(
    "SELECT count(*) FILTER (WHERE label = prediction) AS n_correct, "
    "count(*) FILTER (WHERE label <> prediction) AS n_wrong FROM scored", SCORED_CTE))
def q_error_counts(spark, sf):
    return E.error_counts(scored_fixture(spark, sf))


@query("bernoulli_sample", oracle(
    f"SELECT id FROM loans WHERE substr(md5(concat(CAST(id AS VARCHAR), ':7')), 1, 8) < '{S.hex_bound(0.1)}'"))
def q_bernoulli_sample(spark, sf):
    return S.bernoulli_sample(loans(spark, sf), 0.1, seed=7).select("id")


@query("slice_first", oracle(
    "SELECT id, loan_status FROM loans ORDER BY md5(concat(CAST(id AS VARCHAR), ':0')), id LIMIT 1000"))
def q_slice_first(spark, sf):
    return S.slice_first(loans(spark, sf), 1000, seed=0).select("id", "loan_status")


@query("make_binary", oracle(f"SELECT id, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default FROM loans"))
def q_make_binary(spark, sf):
    return loans(spark, sf).select("id", X.is_default("loan_status", DEFAULT).alias("is_default"))


@query("make_binary_label", oracle(
    f"SELECT id, CASE WHEN loan_status IN {DEF_SQL} THEN 'Default' ELSE 'Non-default' END AS label FROM loans"))
def q_make_binary_label(spark, sf):
    return loans(spark, sf).select("id", X.binary_label("loan_status", DEFAULT).alias("label"))


@query("map_values", oracle(
    f"SELECT DISTINCT loan_status, CASE WHEN loan_status IN {DEF_SQL} THEN 'r' ELSE 'b' END AS colour FROM loans"))
def q_map_values(spark, sf):
    df = loans(spark, sf).select("loan_status").distinct()
    flag = X.is_default("loan_status", DEFAULT)
    return df.select("loan_status", X.value_map(flag, {1: "r", 0: "b"}).alias("colour"))


_CUR_SQL = _sqlist(FIXTURE_STATUSES.current)


@query("status_class", oracle(
    f"SELECT id, CASE WHEN loan_status IN {DEF_SQL} THEN 'default' "
    f"WHEN loan_status IN {_sqlist(FIXTURE_STATUSES.repaid)} THEN 'repaid' "
    f"WHEN loan_status IN {_CUR_SQL} THEN 'current' END AS status_class FROM loans"))
def q_status_class(spark, sf):
    return loans(spark, sf).select("id", X.status_class("loan_status", FIXTURE_STATUSES).alias("status_class"))


@query("all_rows", oracle(
    "SELECT coalesce(bool_and(length(sub_grade) = 2 AND substr(sub_grade, 1, 1) BETWEEN 'A' AND 'G'), true) AS sub_grade_ok, "
    "coalesce(bool_and(term IN (' 36 months', ' 60 months')), true) AS term_ok, "
    "coalesce(bool_and(loan_amnt > 0), true) AS amount_positive FROM loans"))
def q_all_rows(spark, sf):
    sg = F.col("sub_grade")
    return P.all_rows(loans(spark, sf), {
        "sub_grade_ok": (F.length(sg) == 2) & X.first_char(sg).between("A", "G"),
        "term_ok": F.col("term").isin(" 36 months", " 60 months"),
        "amount_positive": F.col("loan_amnt") > 0})


# --- joins and alignment ---------------------------------------------------------------


@query("assemble_columns", oracle(
    "SELECT a.id, a.issue_ns, a.earliest_ns, b.loan_amnt, b.open_acc FROM "
    f"(SELECT id, coalesce(CASE WHEN epoch_ns(CAST({PM('issue_d')} AS TIMESTAMP)) < 0 THEN -99 ELSE epoch_ns(CAST({PM('issue_d')} AS TIMESTAMP)) END, -99) AS issue_ns, "
    f"coalesce(CASE WHEN epoch_ns(CAST({PM('earliest_cr_line')} AS TIMESTAMP)) < 0 THEN -99 ELSE epoch_ns(CAST({PM('earliest_cr_line')} AS TIMESTAMP)) END, -99) AS earliest_ns FROM loans) a "
    "JOIN (SELECT id, round(coalesce(loan_amnt, -99), 6) AS loan_amnt, coalesce(CAST(open_acc AS DOUBLE), -99) AS open_acc FROM loans) b ON a.id = b.id"))
def q_assemble_columns(spark, sf):
    from ..operators.features import assemble_columns
    df = loans(spark, sf)
    dates = df.select("id", X.date_to_ns(X.parse_month("issue_d")).alias("issue_ns"),
                      X.date_to_ns(X.parse_month("earliest_cr_line")).alias("earliest_ns"))
    nums = df.select("id", F.col("loan_amnt").cast("double").alias("loan_amnt"),
                     F.col("open_acc").cast("double").alias("open_acc")).fillna(-99.0)
    return rnd(assemble_columns([dates, nums], on="id"))


MONTHLY_SQL = (f"SELECT last_day({PM('issue_d')}) AS month, round(sum(loan_amnt), 6) AS total, "
               f"count(loan_amnt) AS n, round(sum(loan_amnt) / count(loan_amnt), 6) AS avg "
               f"FROM loans WHERE {PM('issue_d')} IS NOT NULL GROUP BY 1")


@query("aligned_divide", oracle(MONTHLY_SQL))
def q_aligned_divide(spark, sf):
    return rnd(E.monthly(loans(spark, sf), "issue_d", "loan_amnt"))


@query("mask_align", oracle(
    "SELECT c.id, c.loan_amnt FROM (SELECT id, round(loan_amnt, 6) AS loan_amnt FROM loans WHERE last_pymnt_d IS NOT NULL) c "
    f"WHERE c.id IN (SELECT id FROM loans WHERE loan_status IN {DEF_SQL})"))
def q_mask_align(spark, sf):
    df = loans(spark, sf)
    frame = E.drop_missing(df, ["last_pymnt_d"]).select("id", "loan_amnt")
    mask = df.filter(F.col("loan_status").isin(DEFAULT)).select("id")
    return rnd(frame.join(mask, "id", "left_semi"))


@query("status_membership", oracle(f"SELECT id, loan_status FROM loans WHERE loan_status IN {CLOSED_SQL}"))
def q_status_membership(spark, sf):
    dim = spark.createDataFrame([(s,) for s in CLOSED], "loan_status string")
    return loans(spark, sf).select("id", "loan_status").join(F.broadcast(dim), "loan_status", "left_semi")


@query("label_lookup", oracle(
    f"SELECT id, loan_status, CASE WHEN loan_status IN {DEF_SQL} THEN 'default' "
    f"WHEN loan_status IN {_sqlist(FIXTURE_STATUSES.repaid)} THEN 'repaid' "
    f"WHEN loan_status IN {_CUR_SQL} THEN 'current' END AS status_class FROM loans"))
def q_label_lookup(spark, sf):
    rows = ([(s, "default") for s in FIXTURE_STATUSES.default] + [(s, "repaid") for s in FIXTURE_STATUSES.repaid]
            + [(s, "current") for s in FIXTURE_STATUSES.current])
    dim = spark.createDataFrame(rows, "loan_status string, status_class string")  # fixed, bounded
    return loans(spark, sf).select("id", "loan_status").join(F.broadcast(dim), "loan_status", "left")


# --- aggregations ---------------------------------------------------------------------------


@query("row_count", oracle("SELECT count(*) AS n_rows, CAST(17 AS BIGINT) AS n_columns FROM loans"))
def q_row_count(spark, sf):
    return P.row_count(loans(spark, sf))


_TYPES = {"id": "bigint", "open_acc": "bigint"}


def _dtype(c):
    return "double" if c in DOUBLES else _TYPES.get(c, "string")


@query("column_profile", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{_dtype(c)}' AS dtype, count({c}) AS non_null FROM loans" for c in LOAN_COLUMNS)))
def q_column_profile(spark, sf):
    return P.column_profile(loans(spark, sf))


_NF = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS share FROM clean" for c in LOAN_COLUMNS)


@query("null_fraction", oracle(_NF, CLEAN_CTE))
def q_null_fraction(spark, sf):
    return rnd(P.null_fraction(clean(spark, sf)))


@query("sort_desc", oracle(
    f"SELECT row_number() OVER (ORDER BY n_missing DESC, \"column\") AS rank, \"column\", n_missing FROM ({_NF})", CLEAN_CTE))
def q_sort_desc(spark, sf):
    from pyspark.sql import Window
    nf = P.null_fraction(clean(spark, sf))
    w = Window.orderBy(F.desc("n_missing"), F.asc("column"))  # one row per column
    return nf.select(F.row_number().over(w).cast("long").alias("rank"), "column", "n_missing")


@query("sentinel_fraction", oracle("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} = 'n/a') AS n_sentinel, "
    f"round(count(*) FILTER (WHERE {c} = 'n/a') / count(*), 6) AS share FROM loans" for c in STRINGS)
    + ") WHERE n_sentinel > 0"))
def q_sentinel_fraction(spark, sf):
    return rnd(P.sentinel_fraction(loans(spark, sf)))


@query("distinct_values", oracle(" UNION ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", {c} AS value FROM clean WHERE {c} IS NOT NULL" for c in STRINGS), CLEAN_CTE))
def q_distinct_values(spark, sf):
    return P.distinct_values(clean(spark, sf), STRINGS)


@query("distinct_count", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct, "
    f"round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*), 6) AS ratio FROM clean"
    for c in LOAN_COLUMNS), CLEAN_CTE))
def q_distinct_count(spark, sf):
    return rnd(P.distinct_count(clean(spark, sf)))


@query("distinct_count_approx")
def q_distinct_count_approx(spark, sf):
    return rnd(P.distinct_count(clean(spark, sf), approx=True))


@query("value_counts", oracle("SELECT emp_length, count(*) AS n FROM clean WHERE emp_length IS NOT NULL GROUP BY 1", CLEAN_CTE))
def q_value_counts(spark, sf):
    return E.value_counts(clean(spark, sf), "emp_length")


@query("value_shares", oracle(
    f"SELECT is_default, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN loan_status IN {DEF_SQL} "
    "THEN 1 ELSE 0 END AS is_default, count(*) AS n FROM loans GROUP BY 1)"))
def q_value_shares(spark, sf):
    df = loans(spark, sf).select(X.is_default("loan_status", DEFAULT).alias("is_default"))
    return rnd(E.value_shares(df, "is_default"))


@query("group_size", oracle("SELECT loan_status, count(*) AS n FROM loans WHERE loan_status IS NOT NULL GROUP BY 1"))
def q_group_size(spark, sf):
    return E.group_size(loans(spark, sf), "loan_status")


@query("group_sum", oracle(
    "SELECT loan_status, round(sum(loan_amnt), 6) AS sum_loan_amnt FROM loans WHERE loan_status IS NOT NULL GROUP BY 1"))
def q_group_sum(spark, sf):
    return rnd(E.group_sum(loans(spark, sf), "loan_status", "loan_amnt"))


@query("group_sum_by_date", oracle(
    f"SELECT {PM('issue_d')} AS date, round(sum(loan_amnt), 6) AS sum_loan_amnt FROM loans "
    f"WHERE {PM('issue_d')} IS NOT NULL GROUP BY 1"))
def q_group_sum_by_date(spark, sf):
    return rnd(E.group_sum_by_date(loans(spark, sf), "issue_d", "loan_amnt"))


@query("monthly_sum", oracle(f"SELECT month, total FROM ({MONTHLY_SQL})"))
def q_monthly_sum(spark, sf):
    return rnd(E.monthly(loans(spark, sf), "issue_d", "loan_amnt").select("month", "total"))


@query("monthly_count", oracle(f"SELECT month, n FROM ({MONTHLY_SQL})"))
def q_monthly_count(spark, sf):
    return E.monthly(loans(spark, sf), "issue_d", "loan_amnt").select("month", "n")


@query("monthly_avg", oracle(f"SELECT month, avg FROM ({MONTHLY_SQL})"))
def q_monthly_avg(spark, sf):
    return rnd(E.monthly(loans(spark, sf), "issue_d", "loan_amnt").select("month", "avg"))


def _mcs_sql(col):
    return (f"SELECT loan_status, last_day({PM(col)}) AS month, count(*) AS n, round(ln(1 + count(*)), 6) AS log_n, "
            f"CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default FROM loans "
            f"WHERE {PM(col)} IS NOT NULL AND loan_status IS NOT NULL GROUP BY 1, 2")


@query("monthly_count_by_status", oracle(_mcs_sql("issue_d")))
def q_monthly_count_by_status(spark, sf):
    return rnd(E.monthly_count_by_status(loans(spark, sf), "issue_d", DEFAULT))


@query("monthly_count_by_status_last_payment", oracle(_mcs_sql("last_pymnt_d")))
def q_monthly_count_by_status_lp(spark, sf):
    return rnd(E.monthly_count_by_status(loans(spark, sf), "last_pymnt_d", DEFAULT))


_FILL_SQL = (
    ", c AS (SELECT loan_status, month, n FROM (" + _mcs_sql("issue_d") + ")), "
    "r AS (SELECT loan_status, min(month) AS lo, max(month) AS hi FROM c GROUP BY 1), "
    "cal AS (SELECT loan_status, last_day(CAST(unnest(generate_series(date_trunc('month', lo), "
    "date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE)) AS month FROM r)")


@query("month_calendar_fill", oracle(
    "SELECT cal.loan_status, cal.month, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM cal "
    "LEFT JOIN c ON cal.loan_status = c.loan_status AND cal.month = c.month", _FILL_SQL))
def q_month_calendar_fill(spark, sf):
    counts = E.monthly_count_by_status(loans(spark, sf), "issue_d", DEFAULT)
    return E.month_calendar_fill(counts, ["loan_status"])


@query("monthly_log_series", oracle(
    "SELECT cal.loan_status, cal.month, CAST(coalesce(c.n, 0) AS BIGINT) AS n, "
    "round(ln(1 + coalesce(c.n, 0)), 6) AS log_n FROM cal "
    "LEFT JOIN c ON cal.loan_status = c.loan_status AND cal.month = c.month", _FILL_SQL))
def q_monthly_log_series(spark, sf):
    counts = E.monthly_count_by_status(loans(spark, sf), "issue_d", DEFAULT)
    filled = E.month_calendar_fill(counts, ["loan_status"])
    return rnd(filled.withColumn("log_n", X.log1p("n")))


@query("date_value_counts", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {PM(c)} AS date, count(*) AS n FROM loans WHERE {PM(c)} IS NOT NULL GROUP BY 2"
    for c in DATE_COLS)))
def q_date_value_counts(spark, sf):
    return E.date_value_counts(loans(spark, sf), DATE_COLS)


@query("column_min", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 6) AS min FROM loans" for c in NUMERICS)))
def q_column_min(spark, sf):
    return rnd(P.column_min(loans(spark, sf)))


_SKEW_COLS = [c for c in NUMERICS if c != "id"]


@query("column_skewness", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round((SELECT avg(power(CAST({c} AS DOUBLE) - m, 3)) / power(avg(power(CAST({c} AS DOUBLE) - m, 2)), 1.5) "
    f"FROM loans, (SELECT avg(CAST({c} AS DOUBLE)) AS m FROM loans) mm WHERE {c} IS NOT NULL), 6) AS skewness"
    for c in _SKEW_COLS)))
def q_column_skewness(spark, sf):
    return rnd(P.column_skewness(loans(spark, sf), _SKEW_COLS))


@query("counts_of_counts", oracle(
    f"SELECT is_default, count(*) AS n_statuses, CAST(sum(n) AS BIGINT) AS n_loans FROM (SELECT loan_status, count(*) AS n, "
    f"CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default FROM loans GROUP BY 1) GROUP BY 1"))
def q_counts_of_counts(spark, sf):
    return E.counts_of_counts(loans(spark, sf), "loan_status", DEFAULT)


@query("bincount", oracle(
    "SELECT g.value, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c ON g.value = c.value",
    ", c AS (SELECT CAST(open_acc AS BIGINT) AS value, count(*) AS n FROM loans WHERE open_acc IS NOT NULL GROUP BY 1), "
    "g AS (SELECT CAST(unnest(generate_series(0, (SELECT max(value) FROM c))) AS BIGINT) AS value)"))
def q_bincount(spark, sf):
    return E.bincount(loans(spark, sf), "open_acc")


_LEN_COLS = ["sub_grade", "term", "issue_d", "emp_length"]


@query("length_set", oracle(" UNION ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST(length({c}) AS INTEGER) AS length FROM clean WHERE {c} IS NOT NULL"
    for c in _LEN_COLS), CLEAN_CTE))
def q_length_set(spark, sf):
    return P.length_set(clean(spark, sf), _LEN_COLS)


# --- sorts / top-k -------------------------------------------------------------------


@query("head", oracle(_sel(LOAN_COLUMNS) + " ORDER BY id LIMIT 5"))
def q_head(spark, sf):
    return rnd(P.head(loans(spark, sf), 5, "id"))


_DC = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS nd FROM clean"
    for c in LOAN_COLUMNS if c != "id")
_TOP = "SELECT * FROM loans ORDER BY id LIMIT 5"


@query("head_most_distinct", oracle(
    "SELECT CAST(k.rank AS INTEGER) AS rank, k.col AS \"column\", t.id AS row_id, CASE k.col " +
    " ".join(f"WHEN '{c}' THEN CAST(t.{c} AS VARCHAR)" for c in LOAN_COLUMNS if c != "id") +
    " END AS value FROM (SELECT col, row_number() OVER (ORDER BY nd DESC, col) AS rank FROM ("
    + _DC + ") QUALIFY rank <= 3) k, (" + _TOP.replace("loans", "clean") + ") t", CLEAN_CTE))
def q_head_most_distinct(spark, sf):
    return P.head_most_distinct(clean(spark, sf), k=3, n=5)


# --- scalar functions ---------------------------------------------------------------


@query("str_length", oracle("SELECT id, CAST(length(loan_status) AS INTEGER) AS length FROM loans"))
def q_str_length(spark, sf):
    return loans(spark, sf).select("id", X.str_length("loan_status").alias("length"))


@query("last_two", oracle("SELECT id, regexp_extract(issue_d, '..$', 0) AS last_two FROM loans"))
def q_last_two(spark, sf):
    return loans(spark, sf).select("id", X.last_two("issue_d").alias("last_two"))


_DUMMY_SQL = " UNION ".join(
    f"SELECT DISTINCT concat('{c}_', {c}) AS name FROM clean WHERE {c} IS NOT NULL"
    for c in ["addr_state", "emp_length", "home_ownership", "term"])


def _dummy_names(spark, sf):
    df = clean(spark, sf)
    return P.distinct_values(df, ["addr_state", "emp_length", "home_ownership", "term"]).select(
        F.concat(F.col("column"), F.lit("_"), F.col("value")).alias("name"))


@query("clean_name", oracle(
    f"SELECT name, regexp_replace(name, '[\\[\\]<]', '-', 'g') AS clean FROM ({_DUMMY_SQL} UNION "
    "SELECT DISTINCT concat('emp_length_<', emp_length, '[x]') FROM clean WHERE emp_length IS NOT NULL)", CLEAN_CTE))
def q_clean_name(spark, sf):
    df = clean(spark, sf)
    extra = df.filter(F.col("emp_length").isNotNull()).select(
        F.concat(F.lit("emp_length_<"), F.col("emp_length"), F.lit("[x]")).alias("name"))
    names = _dummy_names(spark, sf).union(extra).distinct()
    return names.select("name", X.clean_name("name").alias("clean"))


@query("shorten", oracle(
    f"SELECT name, CASE WHEN length(name) > 22 THEN concat(substr(name, 1, 6), '..', right(name, 11)) ELSE name END AS short "
    f"FROM ({_DUMMY_SQL})", CLEAN_CTE))
def q_shorten(spark, sf):
    return _dummy_names(spark, sf).select("name", X.shorten("name").alias("short"))


@query("first_char", oracle("SELECT id, substr(sub_grade, 1, 1) AS grade FROM loans"))
def q_first_char(spark, sf):
    return loans(spark, sf).select("id", X.first_char("sub_grade").alias("grade"))


@query("sub_grade_ordinal", oracle(
    "SELECT id, CAST((ascii(substr(sub_grade, 1, 1)) - 65) * 5 + CAST(substr(sub_grade, 2, 1) AS INTEGER) AS INTEGER) AS sub_grade_num FROM loans"))
def q_sub_grade_ordinal(spark, sf):
    return loans(spark, sf).select("id", X.sub_grade_ordinal("sub_grade").alias("sub_grade_num"))


@query("string_membership", oracle(
    f"SELECT id, loan_status = 'F/1-URGENT' AS is_urgent, loan_status IN {CLOSED_SQL} AS is_closed FROM loans"))
def q_string_membership(spark, sf):
    s = F.col("loan_status")
    return loans(spark, sf).select("id", (s == "F/1-URGENT").alias("is_urgent"), s.isin(CLOSED).alias("is_closed"))


@query("parse_month", oracle(
    "SELECT id, " + ", ".join(f"{PM(c)} AS {c}" for c in DATE_COLS) + " FROM loans"))
def q_parse_month(spark, sf):
    return loans(spark, sf).select("id", *[X.parse_month(c).alias(c) for c in DATE_COLS])


def _ns_sql(c):
    e = f"epoch_ns(CAST({PM(c)} AS TIMESTAMP))"
    return f"coalesce(CASE WHEN {e} < 0 THEN -99 ELSE {e} END, -99) AS {c}"


@query("date_to_ns", oracle("SELECT id, " + ", ".join(_ns_sql(c) for c in DATE_COLS) + " FROM loans"))
def q_date_to_ns(spark, sf):
    return loans(spark, sf).select("id", *[X.date_to_ns(X.parse_month(c)).alias(c) for c in DATE_COLS])


@query("month_end", oracle(f"SELECT id, last_day({PM('issue_d')}) AS month FROM loans"))
def q_month_end(spark, sf):
    return loans(spark, sf).select("id", X.month_end(X.parse_month("issue_d")).alias("month"))


@query("date_compare", oracle(f"SELECT id, {PM('earliest_cr_line')} < DATE '1970-01-01' AS pre_epoch FROM loans"))
def q_date_compare(spark, sf):
    return loans(spark, sf).select(
        "id", (X.parse_month("earliest_cr_line") < F.to_date(F.lit("1970-01-01"))).alias("pre_epoch"))


@query("log1p", oracle("SELECT id, round(ln(1 + loan_amnt), 6) AS log_amnt FROM loans"))
def q_log1p(spark, sf):
    return rnd(loans(spark, sf).select("id", X.log1p("loan_amnt").alias("log_amnt")))


@query("log_shift", oracle(
    "SELECT id, round(CASE WHEN annual_inc + 10 > 0 THEN ln(annual_inc + 10) END, 6) AS log_inc FROM loans"))
def q_log_shift(spark, sf):
    return rnd(loans(spark, sf).select("id", X.log_shift("annual_inc", 10.0).alias("log_inc")))


@query("pct_round", oracle(
    "SELECT loan_status, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM loans), 1) AS pct "
    "FROM loans WHERE loan_status IS NOT NULL GROUP BY 1"))
def q_pct_round(spark, sf):
    df = loans(spark, sf)
    total = df.agg(F.count(F.lit(1))).scalar()
    return E.group_size(df, "loan_status").select("loan_status", "n", X.pct_round("n", total).alias("pct"))


@query("safe_ratio", oracle(
    "SELECT addr_state, round(coalesce(sum(recoveries) / nullif(sum(loan_amnt), 0), 0), 6) AS recovery_ratio "
    "FROM loans GROUP BY 1"))
def q_safe_ratio(spark, sf):
    return rnd(loans(spark, sf).groupBy("addr_state").agg(
        X.safe_ratio(F.sum("recoveries"), F.sum("loan_amnt")).alias("recovery_ratio")))


@query("negative_to", oracle(
    "SELECT id, round(CASE WHEN annual_inc < 0 THEN -99 ELSE annual_inc END, 6) AS annual_inc FROM loans"))
def q_negative_to(spark, sf):
    return rnd(loans(spark, sf).select("id", X.negative_to("annual_inc", -99.0).alias("annual_inc")))


@query("fill_missing", oracle(
    "SELECT id, coalesce(CAST(open_acc AS DOUBLE), -99) AS open_acc, round(coalesce(total_acc, -99), 6) AS total_acc, "
    "round(coalesce(dti, -99), 6) AS dti FROM loans"))
def q_fill_missing(spark, sf):
    df = loans(spark, sf).select("id", F.col("open_acc").cast("double").alias("open_acc"), "total_acc", "dti")
    return rnd(df.fillna(catalog.MISSING_FILL))


# --- plot data ---------------------------------------------------------------


_HIST = (", mm AS (SELECT min(loan_amnt) AS lo, max(loan_amnt) AS hi FROM loans WHERE loan_amnt IS NOT NULL), "
         "b AS (SELECT {key}CAST(CASE WHEN (hi - lo) / 20.0 > 0 THEN least(floor((loan_amnt - lo) / ((hi - lo) / 20.0)), 19) "
         "ELSE 0 END AS INTEGER) AS bin, lo, hi FROM loans, mm WHERE loan_amnt IS NOT NULL)")


@query("histogram", oracle(
    "SELECT bin, round(lo + bin * ((hi - lo) / 20.0), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20.0), 6) AS hi, "
    "count(*) AS n FROM b GROUP BY bin, b.lo, b.hi", _HIST.format(key="")))
def q_histogram(spark, sf):
    return rnd(E.histogram(loans(spark, sf), "loan_amnt", 20))


@query("histogram_by_status", oracle(
    "SELECT is_default, bin, round(lo + bin * ((hi - lo) / 20.0), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20.0), 6) AS hi, "
    "count(*) AS n FROM b GROUP BY is_default, bin, b.lo, b.hi",
    _HIST.format(key=f"CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default, ")))
def q_histogram_by_status(spark, sf):
    df = loans(spark, sf).withColumn("is_default", X.is_default("loan_status", DEFAULT))
    return rnd(E.histogram(df, "loan_amnt", 20, by="is_default"))


@query("status_bars", oracle(
    "SELECT loan_status, count(*) AS n, round(sum(loan_amnt), 6) AS total, round(ln(1 + count(*)), 6) AS log_n, "
    f"round(ln(1 + sum(loan_amnt)), 6) AS log_total, CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default "
    "FROM loans WHERE loan_status IS NOT NULL GROUP BY 1"))
def q_status_bars(spark, sf):
    return rnd(E.status_bars(loans(spark, sf), "loan_status", "loan_amnt", DEFAULT))


@query("status_shares", oracle(
    "SELECT loan_status, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM loans), 1) AS pct "
    "FROM loans WHERE loan_status IS NOT NULL GROUP BY 1"))
def q_status_shares(spark, sf):
    return E.status_shares(loans(spark, sf), "loan_status")


# --- distributions (PLT-2, PLT-3) ----------------------------------------------------

from ..operators import distribution as D  # noqa: E402

_DECILES = [i / 10 for i in range(11)]


@query("exact_quantiles", oracle(" UNION ALL ".join(
    f"SELECT round(CAST({p!r} AS DOUBLE), 6) AS p, round(quantile_cont(loan_amnt, {p!r}), 6) AS q "
    "FROM loans WHERE loan_amnt IS NOT NULL" for p in _DECILES)))
def q_exact_quantiles(spark, sf):
    # small accuracy so the bracket/verify/rank path is really exercised
    return rnd(D.exact_quantiles(loans(spark, sf), "loan_amnt", _DECILES, accuracy=200))


@query("exact_quantiles_tied", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS col, round(CAST({p!r} AS DOUBLE), 6) AS p, round(quantile_cont(CAST({c} AS DOUBLE), {p!r}), 6) AS q "
    f"FROM loans WHERE {c} IS NOT NULL" for c in ("recoveries", "open_acc") for p in _DECILES)))
def q_exact_quantiles_tied(spark, sf):
    """Columns of which most rows hold one value, or few distinct ones."""
    df = loans(spark, sf)
    parts = [D.exact_quantiles(df, c, _DECILES, accuracy=200).select(F.lit(c).alias("col"), "p", "q")
             for c in ("recoveries", "open_acc")]
    return rnd(parts[0].unionByName(parts[1]))


@query("box_stats", oracle(
    "SELECT w.loan_status, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
    "round(min(loan_amnt) FILTER (WHERE loan_amnt >= wlo), 6) AS whisker_lo, "
    "round(max(loan_amnt) FILTER (WHERE loan_amnt <= whi), 6) AS whisker_hi, "
    "count(*) FILTER (WHERE loan_amnt < wlo OR loan_amnt > whi) AS n_outliers, count(*) AS n "
    "FROM loans JOIN w ON loans.loan_status = w.loan_status WHERE loan_amnt IS NOT NULL "
    "GROUP BY w.loan_status, q1, median, q3",
    ", q AS (SELECT loan_status, quantile_cont(loan_amnt, 0.25) AS q1, quantile_cont(loan_amnt, 0.5) AS median, "
    "quantile_cont(loan_amnt, 0.75) AS q3 FROM loans WHERE loan_amnt IS NOT NULL GROUP BY 1), "
    "w AS (SELECT *, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS wlo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS whi FROM q)"))
def q_box_stats(spark, sf):
    return rnd(D.box_stats(loans(spark, sf), "loan_amnt", ["loan_status"], accuracy=500))


_KDE = (", st AS (SELECT count(*) AS n, min(dti) AS mn, max(dti) AS mx, stddev_samp(dti) AS sd FROM loans WHERE dti IS NOT NULL), "
        "p AS (SELECT n, mn, mx, sd * pow(CAST(n AS DOUBLE), -0.2) AS h, (mx - mn) / CAST(1024 AS DOUBLE) AS bw FROM st), "
        "g AS (SELECT mn - 3 * h AS g0, ((mx + 3 * h) - (mn - 3 * h)) / CAST(99 AS DOUBLE) AS step FROM p), "
        "hist AS (SELECT CAST(CASE WHEN bw > 0 THEN least(floor((dti - mn) / bw), 1023) ELSE 0 END AS INTEGER) AS bin, "
        "count(*) AS m FROM loans, p WHERE dti IS NOT NULL GROUP BY 1), "
        "c AS (SELECT m, mn + (bin + CAST(0.5 AS DOUBLE)) * bw AS c FROM hist, p), "
        "pairs AS (SELECT m, c, unnest(generate_series(0, 99)) AS i FROM c)")


@query("kde", oracle(
    "SELECT CAST(i AS INTEGER) AS i, round(g0 + i * step, 6) AS x, "
    "round(sum(m * exp(-0.5 * ((g0 + i * step - c) / h) * ((g0 + i * step - c) / h))) / (n * h * sqrt(2 * pi())), 6) AS density "
    "FROM pairs, p, g GROUP BY i, g0, step, n, h", _KDE))
def q_kde(spark, sf):
    return rnd(D.kde(loans(spark, sf), "dti", grid_points=100, bins=1024))


_KDE_EXACT = (", st AS (SELECT count(*) AS n, min(dti) AS mn, max(dti) AS mx, stddev_samp(dti) AS sd FROM loans WHERE dti IS NOT NULL), "
              "p AS (SELECT n, mn, mx, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st), "
              "g AS (SELECT i, mn - 3 * h + i * (((mx + 3 * h) - (mn - 3 * h)) / CAST(99 AS DOUBLE)) AS x "
              "FROM p, (SELECT unnest(generate_series(0, 99)) AS i))")


@query("kde_exact", oracle(
    "SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, "
    "round(sum(exp(-0.5 * ((x - dti) / h) * ((x - dti) / h))) / (n * h * sqrt(2 * pi())), 6) AS density "
    "FROM loans, g, p WHERE dti IS NOT NULL GROUP BY i, x, n, h", _KDE_EXACT))
def q_kde_exact(spark, sf):
    """The density without a number of bins; the oracle sums over all rows."""
    return rnd(D.kde(loans(spark, sf), "dti", grid_points=100))


def _kde_by(x: str) -> str:
    return oracle(
        "SELECT loan_status, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(CASE WHEN h > 0 THEN d END, 6) AS density FROM ("
        "SELECT g.loan_status, g.i, g.x, g.h, sum(exp(-0.5 * ((g.x - v.x) / g.h) * ((g.x - v.x) / g.h))) / (g.n * g.h * sqrt(2 * pi())) AS d "
        "FROM g JOIN v ON g.loan_status = v.loan_status GROUP BY g.loan_status, g.i, g.x, g.h, g.n)",
        f", v AS (SELECT loan_status, CAST({x} AS DOUBLE) AS x FROM loans WHERE {x} IS NOT NULL), "
        "st AS (SELECT loan_status, count(*) AS n, min(x) AS mn, max(x) AS mx, "
        "stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h FROM v GROUP BY 1), "
        "g AS (SELECT loan_status, n, CASE WHEN mx > mn THEN h ELSE 0 END AS h, i, "
        "CASE WHEN mx > mn THEN mn - 3 * h + i * ((mx - mn + 6 * h) / CAST(99 AS DOUBLE)) ELSE mn END AS x "
        "FROM st, (SELECT unnest(generate_series(0, 99)) AS i) WHERE mx > mn OR i = 0)")


@query("kde_by_status", _kde_by("dti"))
def q_kde_by_status(spark, sf):
    return rnd(D.kde_by(loans(spark, sf), "dti", ["loan_status"]))


@query("kde_dates_by_status", _kde_by("date_diff('day', DATE '1970-01-01', strptime(last_pymnt_d, '%b-%Y')::DATE)"))
def q_kde_dates_by_status(spark, sf):
    """The density of a date column per status (days since 1970-01-01)."""
    df = loans(spark, sf).withColumn("last_pymnt_d", X.parse_month("last_pymnt_d"))
    return rnd(D.kde_by(df, "last_pymnt_d", ["loan_status"]))


@query("box_stats_by_default", oracle(
    "SELECT w.is_default, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, "
    "round(min(loan_amnt) FILTER (WHERE loan_amnt >= wlo), 6) AS whisker_lo, "
    "round(max(loan_amnt) FILTER (WHERE loan_amnt <= whi), 6) AS whisker_hi, "
    "count(*) FILTER (WHERE loan_amnt < wlo OR loan_amnt > whi) AS n_outliers, count(*) AS n "
    "FROM t JOIN w ON t.is_default = w.is_default WHERE loan_amnt IS NOT NULL "
    "GROUP BY w.is_default, q1, median, q3",
    f", t AS (SELECT CASE WHEN loan_status IN {DEF_SQL} THEN 1 ELSE 0 END AS is_default, loan_amnt FROM loans), "
    "q AS (SELECT is_default, quantile_cont(loan_amnt, 0.25) AS q1, quantile_cont(loan_amnt, 0.5) AS median, "
    "quantile_cont(loan_amnt, 0.75) AS q3 FROM t WHERE loan_amnt IS NOT NULL GROUP BY 1), "
    "w AS (SELECT *, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS wlo, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS whi FROM q)"))
def q_box_stats_by_default(spark, sf):
    df = loans(spark, sf).select(X.is_default("loan_status", DEFAULT).alias("is_default"), "loan_amnt")
    # small accuracy: the default group (a third of the loans or less) goes through the bracket path
    return rnd(D.box_stats(df, "loan_amnt", ["is_default"], accuracy=300))
