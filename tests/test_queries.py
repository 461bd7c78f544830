"""Every SQL-expressible registered query against its DuckDB oracle on the
sf0.001 tables (the driver does the same at sf0.01)."""

import math

import duckdb
import pytest

from loanlab.plans.registry import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
REG = all_queries()
SQL_NAMES = sorted(n for n, (_, sql) in REG.items() if sql is not None)


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    c.execute("SET TimeZone='UTC'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6))
    return str(v)[:10] if hasattr(v, "isoformat") and str(v).endswith("00:00:00") else str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_entry():
    import __spark_entry__ as e
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


@pytest.mark.parametrize("name", SQL_NAMES)
def test_query_matches_oracle(spark, con, sf001, name):
    fn, sql = REG[name]
    df = fn(spark, sf001)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, drows)
