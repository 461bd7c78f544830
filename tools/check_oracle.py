"""Local correctness check: every registered query in Spark vs its DuckDB
oracle on the same Parquet tables (row count, column names, sorted values).

usage: python tools/check_oracle.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "")
        return (1, round(v, 6))
    if hasattr(v, "isoformat"):
        return (1, str(v)[:10] if len(str(v)) >= 10 and str(v)[10:].strip("0: ") == "" else str(v))
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int,)):
        return (1, float(v))
    if hasattr(v, "tolist"):
        return (1, str(v.tolist()))
    return (1, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((a, str(b)) for a, b in t))


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    pats = [a for a in args if a != sf]
    from loanlab.session import get_session
    from loanlab.plans.registry import all_queries
    spark = get_session("local[8]", shuffle_partitions=8, extra={"spark.ui.showConsoleProgress": "false"})
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    reg = all_queries()
    bad = 0
    for name, (fn, sql) in reg.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL-SPARK {name}: {str(e)[:600]}")
            continue
        ts = time.time() - t0
        if sql is None:
            print(f"rows-only  {name}: {len(srows)} rows {ts:.1f}s")
            continue
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL-SQL   {name}: {str(e)[:600]}")
            continue
        msg = []
        if sorted(scols) != sorted(dcols):
            msg.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            msg.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not msg:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                msg.append(f"values differ e.g. {diff}")
        if msg:
            bad += 1
            print(f"MISMATCH   {name}: " + "; ".join(msg)[:900])
        else:
            print(f"ok         {name}: {len(srows)} rows {ts:.1f}s")
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
