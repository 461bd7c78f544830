"""Plan shape of every SQL-checked query: no cartesian product, no
nested-loop join, no row-at-a-time Python in the plan."""

import pytest

from loanlab.plans.registry import all_queries

REG = all_queries()
NAMES = sorted(n for n, (_, sql) in REG.items() if sql is not None)
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_pairs_or_python(spark, sf001, name):
    df = REG[name][0](spark, sf001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan]


def test_pruning_and_pushdown_on_parquet(spark, tmp_path, sf001):
    """On a stored loan table the status filter reaches the scan and only the
    needed columns are read."""
    from loanlab.operators import explore as E
    from loanlab.plans.registry import loans
    path = str(tmp_path / "loans")
    loans(spark, sf001).write.parquet(path)
    t = spark.read.parquet(path)
    q = E.filter_status_in(t, ["F/1-URGENT", "F/2-HIGH"]).select("id", "loan_amnt")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "In(loan_status, [F/1-URGENT,F/2-HIGH])]" in plan   # PushedFilters of the scan
    assert "ReadSchema: struct<id:bigint,loan_amnt:double,loan_status:string>" in plan
    m = E.monthly_count_by_status(t, "issue_d", ["F/1-URGENT"])
    mplan = m._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<loan_status:string,issue_d:string>" in mplan
    assert "partial_count" in mplan   # map-side partial aggregation before the shuffle
