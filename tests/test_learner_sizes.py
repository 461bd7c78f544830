"""The registered learners are as large as the reference's."""

from unittest.mock import MagicMock

import pytest

from loanlab.plans import q_models as Q


class Seen(Exception):
    pass


@pytest.fixture
def sizes(spark, monkeypatch):
    found = {}

    def forest(num_trees=None, max_depth=None, **kw):
        found.update(trees=num_trees, depth=max_depth)
        est = MagicMock()
        est.fit.side_effect = Seen
        return est

    monkeypatch.setattr(Q, "_prep", lambda *a: MagicMock())
    monkeypatch.setattr(Q.FE, "make_multiclass", lambda t: (MagicMock(), MagicMock()))
    monkeypatch.setattr(Q.M, "random_forest", forest)
    return found


@pytest.mark.parametrize("name", ["predict_proba", "feature_importance", "top_k_importance", "select_top_importance",
                                  "select_ranked_features"])
def test_sizes(sizes, spark, name):
    with pytest.raises(Seen):
        getattr(Q, f"q_{name}")(spark, "nowhere")
    assert (sizes["trees"], sizes["depth"]) == (50, 30)


# query -> (trees of a fit, fits, least rows of a node that is split)
GROWN = {"random_forest": (50, 1, 10), "random_forest_multiclass": (50, 1, 20), "cross_val_predict": (50, 3, 20),
         "cross_val_score": (50, 3, 20), "oob_score": (50, 1, 20), "bagged_forest": (50, 1, 20), "grid_search": (100, 4, 20),
         "learning_curve": (20, 15, 20), "learning_curve_means": (20, 15, 20)}


@pytest.mark.parametrize("name", GROWN)
def test_grown_sizes(spark, sf001, monkeypatch, name):
    """A real run on the smallest tables: as many trees as stated, none cut short of the stated settings."""
    seen, grow = [], Q.FO.grow

    def spy(df, fits, classes=2, max_depth=30, min_split=2, **kw):
        model = grow(df, fits, classes, max_depth, min_split, **kw)
        seen.append((fits, max_depth, min_split, model))
        return model
    monkeypatch.setattr(Q.FO, "grow", lambda df, fits, *a, **kw: spy(df, fits, *a, **kw) if len(a) < 4 else spy(
        df, fits, *a[:3], **dict(zip(("max_bins", "seed", "label", "features"), a[3:], strict=False)), **kw))
    out = getattr(Q, f"q_{name}")(spark, sf001)
    assert out.count() > 0
    trees, n_fits, least = GROWN[name]
    (fits, depth, min_split, model), = seen
    assert [f.trees for f in fits] == [trees] * n_fits and (depth, min_split) == (30, least)
    got = model.nodes.groupBy().agg({"tree": "max", "depth": "max"}).first()
    assert got["max(tree)"] == trees * n_fits - 1 and 4 < got["max(depth)"] <= 30
    assert model.nodes.where(f"feature >= 0 and rows < {least}").count() == 0


def test_grid_holds_the_reference_point(spark, sf001):
    points = [r.point for r in Q.q_grid_search(spark, sf001).collect()]
    assert points == ["numTrees=50, maxDepth=12", "numTrees=50, maxDepth=30", "numTrees=100, maxDepth=12", "numTrees=100, maxDepth=30"]
