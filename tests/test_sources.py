import random

import pytest

from loanlab.catalog import loan_schema
from loanlab.plans import registry
from loanlab.sources.loans import count_malformed, load_loans, null_sentinel


def test_csv_with_schema_keeps_text(spark, tmp_path):
    cols = [f.name for f in loan_schema().fields]
    row = {c: "" for c in cols}
    row.update({"id": "7", "loan_amnt": "1000.5", "term": " 36 months", "emp_length": "n/a",
                "desc": '"line one\nline two"', "loan_status": "Fully Paid", "issue_d": "Dec-2011"})
    text = ",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n"
    p = tmp_path / "loan.csv"
    p.write_text(text)
    df = load_loans(spark, str(p))
    r = null_sentinel(df).first()
    assert r.id == 7 and r.loan_amnt == 1000.5
    assert r.term == " 36 months"                 # leading blank kept (category value)
    assert r.desc == "line one\nline two"          # multi-line free text
    assert r.emp_length is None                    # sentinel -> missing
    assert len(df.columns) == 74


def test_stored_loan_table_gives_same_rows(spark, sf001, tmp_path):
    fn = registry.all_queries()["monthly_count_by_status"][0]
    a = sorted(tuple(r) for r in fn(spark, sf001).collect())
    registry.store_loans(spark, sf001, str(tmp_path / "loans"))
    try:
        b = sorted(tuple(r) for r in fn(spark, sf001).collect())
    finally:
        registry.use_stored_loans(sf001, None)
    assert a == b


def test_csv_columns_go_by_header_name(spark, tmp_path):
    cols = [f.name for f in loan_schema().fields]
    random.Random(5).shuffle(cols)
    rows = [{"id": "1", "loan_amnt": "10.5", "int_rate": "NaN", "grade": "B"},
            {"id": "2", "loan_amnt": "not a number", "int_rate": "3", "grade": "C"}]
    p = tmp_path / "shuffled.csv"
    p.write_text("\n".join([",".join(cols)] + [",".join(r.get(c, "") for c in cols) for r in rows]) + "\n")
    got = {r.id: (r.loan_amnt, r.int_rate, r.grade, r.url) for r in load_loans(spark, str(p)).collect()}
    assert got == {1: (10.5, None, "B", None), 2: (None, 3.0, "C", None)}
    assert count_malformed(spark, str(p)) == 1
    p.write_text("id,other\n1,2\n")
    with pytest.raises(ValueError, match="other"):
        load_loans(spark, str(p))


def test_quoted_line_feeds_in_many_tasks(spark, tmp_path):
    """Every split size gives the records that one task reads from the whole file."""
    from loanlab.sources.records import csv_records
    rng = random.Random(8)

    def cell():
        kind = rng.randrange(6)
        plain = "".join(rng.choice("abé ") for _ in range(rng.randrange(8)))
        if kind == 0:
            return '"' + "".join(rng.choice(['a', ',', '\n', '""', ' ', '\n\n']) for _ in range(rng.randrange(60))) + '"'
        return {1: plain + '5" pipe', 2: '""', 3: ""}.get(kind, "x" + plain)
    for k, end in (("a", "\n"), ("b", "\n"), ("c", "\r\n")):
        body = [",".join([str(i), cell().replace("\n", "\n"), cell(), "end"]) for i in range(150)]
        (tmp_path / f"{k}.csv").write_bytes((end.join(["id,x,y,z", *body, "", '9999,"no end' if k == "b" else "9999,1,2,3"])
                                             + ("" if k == "b" else end)).encode())
    options = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ddl = "id string, x string, y string, z string"
    want = sorted(map(str, spark.read.options(**options).schema(ddl).csv(str(tmp_path)).where("id < 9999").collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4000", "700", "90", "17"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = csv_records(spark, str(tmp_path)).selectExpr("regexp_replace(record, '\r$', '') record")
            got = found.selectExpr(f"from_csv(record, '{ddl}', map('escape', '\"', 'ignoreLeadingWhiteSpace', 'false', "
                                   "'ignoreTrailingWhiteSpace', 'false')) r").select("r.*").where("id < 9999")
            assert sorted(map(str, got.collect())) == want, size
        assert found.rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(want) == 450
