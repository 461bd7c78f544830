from pyspark.sql import functions as F

from loanlab.plans import workflows as W
from loanlab.plans.registry import loans
from loanlab.sources.fixture import FIXTURE_FEATURES, FIXTURE_STATUSES


def test_prepare_and_approaches(spark, sf001):
    lv = loans(spark, sf001)
    p = W.prepare(lv, FIXTURE_STATUSES, FIXTURE_FEATURES)
    n_train, n_test = p.train.count(), p.test.count()
    assert n_test == -(-3 * (n_train + n_test) // 10)        # exactly ceil(0.3 n)
    assert p.train.join(p.test, "id").count() == 0
    assert sorted(r.fold for r in p.train.select("fold").distinct().collect()) == [0, 1, 2]
    cv, test, imp = W.approach_one(p, num_trees=5, ada_rounds=3, max_depth=5)
    assert sorted(r.model for r in test.collect()) == ["AB", "LDA", "RF"]
    assert all(0 <= r.auc <= 1 for r in test.collect())
    assert imp.count() == len(p.names)
    p.unpersist()
    p2 = W.prepare(lv, FIXTURE_STATUSES, FIXTURE_FEATURES, application_only=True, closed_only=True)
    assert "recoveries" not in p2.columns and "issue_d" not in p2.columns
    out = W.approach_two(p2, FIXTURE_STATUSES, num_trees=5, max_depth=5)
    assert out["cv_scores"].count() == 3
    assert out["cutoff"].first().recall >= 0.5
    assert out["importance"].count() == 10
