"""The joint forest against plain versions: equal trees however they are grown, hand-counted out-of-bag votes, cuts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loanlab.operators import bagging as BG, forest as FO, models as M, validate as VA


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 5, n), np.ones(n),
                         rng.exponential(size=n)])
    y = ((x[:, 0] + 0.7 * x[:, 1] + 0.8 * x[:, 2] + 0.3 * rng.normal(size=n)) > 0.4).astype(int)
    rows = [(i, float(y[i]), x[i].tolist(), i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label double, x array<double>, fold int")
    return df.select("id", "label", array_to_vector("x").alias("features"), "fold").repartition(5).persist()


def _nodes(model):
    return sorted((r.tree, r.node, r.depth, r.feature, r.bin, r.rows, tuple(r.counts)) for r in model.nodes.collect())


def test_passes_and_single_tasks_make_the_same_trees(data):
    a = FO.grow(data, [FO.Fit("all", 4)], min_split=6)
    for local, parts in ((150, 5), (0, 3)):  # no node, at last, small enough for one task
        b = FO.grow(data.repartition(parts), [FO.Fit("all", 4)], min_split=6, max_depth=6 if local == 0 else 30, local_rows=local)
        if local:
            assert _nodes(b) == _nodes(a)
        else:
            assert _nodes(b) == _nodes(FO.Forest(FO.cut(a, 0, 4, 6, 6), a.bounds, 2, a.seed))
    split = [r for r in a.nodes.collect() if r.feature >= 0]
    assert min(r.rows for r in split) >= 6 and a.nodes.count() == 2 * len(split) + 4


def test_a_tree_by_hand(data):
    """Every node's rows, counts and split, recomputed with plain loops."""
    model = FO.grow(data, [FO.Fit("all", 2)], min_split=25)
    rows = data.withColumn("key", F.xxhash64("id")).collect()
    key, y = np.array([r.key for r in rows]), np.array([int(r.label) for r in rows])
    x = np.array([r.features.toArray() for r in rows])
    bins = np.column_stack([np.searchsorted(np.array(b), x[:, j], side="left") for j, b in enumerate(model.bounds)])
    for tree in range(2):
        nodes = {r.node: r for r in model.nodes.where(F.col("tree") == tree).collect()}
        times = FO.multiplicity(key, tree, model.seed)
        assert abs(times.mean() - 1) < 0.15 and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.06)
        at = {0: np.flatnonzero(times > 0)}
        while at:
            node, own = at.popitem()
            r = nodes.pop(node)
            assert r.rows == len(own) and r.counts == [float(times[own][y[own] == c].sum()) for c in (0, 1)]
            if r.feature < 0:
                assert len(own) < 25 or 0.0 in r.counts or r.depth == 30
                continue
            feats = FO._order(tree, node, model.seed, 6)[:2]
            gains = {}
            for f in feats:
                for cut in range(64):
                    left, right = own[bins[own, f] <= cut], own[bins[own, f] > cut]
                    if len(left) and len(right):
                        gains[(int(f), cut)] = sum(sum(times[p][y[p] == c].sum() ** 2 for c in (0, 1)) / times[p].sum()
                                                   for p in (left, right))
            if gains:
                assert gains[(r.feature, r.bin)] == pytest.approx(max(gains.values()))
            go = bins[own, r.feature] <= r.bin
            at[2 * node + 1], at[2 * node + 2] = own[go], own[~go]
        assert not nodes


def test_out_of_bag_votes_by_hand(data):
    forest = BG.fit_bagged_trees(data, num_trees=9, min_split=10)
    rows = data.withColumn("key", F.xxhash64("id")).collect()
    nodes = {(r.tree, r.node): r for r in forest.nodes.collect()}
    right = scored = 0
    votes = {r.id: r.oob_prediction for r in BG.oob_predict(data, forest).collect()}
    for r in rows:
        total = np.zeros(2)
        for tree in range(9):
            if FO.multiplicity(np.array([r.key]), tree, BG.SEED)[0] == 0:
                node = nodes[(tree, 0)]
                while node.feature >= 0:
                    b = np.searchsorted(np.array(forest.bounds[node.feature]), r.features[node.feature], side="left")
                    node = nodes[(tree, 2 * node.node + 1 + int(b > node.bin))]
                total += np.array(node.counts) / sum(node.counts)
        want = int(total.argmax()) if total.any() else None
        assert votes[r.id] == want
        scored += want is not None
        right += want == int(r.label)
    got = BG.oob_score(data, forest).first()
    assert got.n_scored == scored and got.oob_accuracy == pytest.approx(right / scored) and got.oob_accuracy > 0.8


def test_cuts_are_the_forests_grown_so(data):
    folds = [FO.Fit(str(i), 6, F.col("fold") != i) for i in range(3)]
    large = FO.grow(data, folds)
    # a tree's number is part of its hash: a fit of its own with the same numbers is the same forest
    small = FO.grow(data, [FO.Fit("0", 6, F.col("fold") != 0)], max_depth=4, min_split=30)
    assert _nodes(small) == _nodes(FO.Forest(FO.cut(large, 0, 6, 4, 30), large.bounds, 2, large.seed))
    one = FO.score(small, data.where("fold = 0"), trees=3).orderBy("id").collect()
    two = FO.score(large, data.where("fold = 0"), {"0": F.lit(True)}, trees=3, max_depth=4, min_split=30).orderBy("id").collect()
    assert one == two
    table = VA.forest_grid_search(data, (3, 6), (4, 30), (2, 30))
    points = {r.point: r.accuracy for r in table[1].collect()}
    assert len(points) == 8
    accs = [FO.score(large, data.where(F.col("fold") == i), {str(i): F.lit(True)}, trees=3, max_depth=4, min_split=30).agg(
        FO.accuracy(None)).first()[0] for i in range(3)]
    assert points["numTrees=3, maxDepth=4, minSplit=30"] == pytest.approx(np.mean(accs))
    assert FO.score(table[0], data).agg(FO.accuracy(None)).first()[0] > 0.85


def test_folds_curve_and_blocks(data, monkeypatch):
    oof = VA.forest_cross_val_predict(data, 8, min_split=10)
    rows = oof.collect()
    assert sorted((r.id, r.fold) for r in rows) == sorted((r.id, r.fold) for r in data.select("id", "fold").collect())
    assert np.mean([r.label == r.prediction for r in rows]) > 0.8
    curve = VA.forest_learning_curve(data, 4, sizes=(0.3, 1.0), min_split=10)
    got = sorted(map(tuple, curve.collect()))
    assert [(r[0], r[1]) for r in got] == [(0.3, 0), (0.3, 1), (0.3, 2), (1.0, 0), (1.0, 1), (1.0, 2)]
    assert all(r[3] > 0.85 and r[4] > 0.75 for r in got) and [r[2] for r in got[3:]] == [600] * 3
    monkeypatch.setattr(FO, "NODES_SENT", 150)  # trees go out in blocks, parts one by one
    assert sorted(VA.forest_cross_val_predict(data, 8, min_split=10).collect()) == sorted(rows)
    again = sorted(map(tuple, VA.forest_learning_curve(data, 4, sizes=(0.3, 1.0), min_split=10).collect()))
    assert [r[:3] for r in again] == [r[:3] for r in got] and np.allclose([r[3:] for r in again], [r[3:] for r in got])


def test_large_models_do_not_pass_through_the_driver(data, monkeypatch):
    """Rows are led to the tasks that have the nodes: the same votes, and no node table on the driver."""
    model = FO.grow(data, [FO.Fit(str(i), 5, F.col("fold") != i) for i in range(3)], min_split=10, local_rows=100)
    own = {str(i): F.col("fold") == i for i in range(3)}
    parts = [FO.Part(f"{i}{d}{t}", str(i), F.col("fold") == i, t, d, 15) for i in range(3) for d in (1, 3, 30) for t in (2, 5)]

    def all_of_it():
        yield FO.score(model, data, own, keep=("fold",))
        yield FO.score(model, data, {"1": F.col("fold") != 1}, oob=True)
        yield FO.score(model, data, {"2": F.lit(True)}, trees=3, max_depth=2)
        yield FO.score(FO.Forest(FO.cut(model, 5, 4, 2, 20), model.bounds, 2, model.seed, {"cut": (5, 4)}), data.drop("label"))
        yield FO.part_accuracy(model, data, parts)
    plain = [sorted(map(repr, df.collect())) for df in all_of_it()]
    for name, value in (("NODES_SENT", 0), ("LOCAL_ROWS", 60), ("CHUNK_BITS", 5)):  # groups dealt to several, many chunks
        monkeypatch.setattr(FO, name, value)
    monkeypatch.setattr(FO, "_packed_trees", None)
    assert [sorted(map(repr, df.collect())) for df in all_of_it()] == plain


def test_deep_forest_stands_in_for_the_learner(data):
    """Fitted without Spark's forest: probabilities, predictions and importances of the joint growth."""
    model = M.random_forest(10, max_depth=30).fit(data)
    forest = FO.grow(data, [FO.Fit("all", 10)])
    want = {r.id: (r.prediction, r.score) for r in FO.score(forest, data).collect()}
    assert {r.id: (r.prediction, r.score) for r in M.score(model, data).collect()} == want
    out = model.transform(data).first()
    assert sum(out.probability.toArray()) == pytest.approx(1) and {"id", "label", "fold"} <= set(out.asDict())
    names = [f"f{i}" for i in range(6)]
    top = M.top_k_importance(M.feature_importance(model, names), 3).collect()
    assert top[0].feature == "f0" and sum(model.featureImportances.toArray()) == pytest.approx(1)
    sliced = M.slice_features(data, M.top_indices(M.feature_importance(model, names), names, 3))
    again = M.deep_forest(10, features="features_k").fit(sliced)
    assert M.score(again, sliced).where("label = prediction").count() > 800


def test_classes_weights_importance_and_odd_rows(spark, data):
    names = [f"f{i}" for i in range(6)]
    three = data.withColumn("label", F.when(F.col("id") % 7 == 0, 2.0).otherwise(F.col("label")))
    three = three.withColumn("w", F.when(F.col("label") == 2, 20.0).otherwise(1.0))
    plain = FO.score(FO.grow(three, [FO.Fit("a", 5)], 3, min_split=10), three).where("prediction = 2").count()
    heavy = FO.score(FO.grow(three, [FO.Fit("a", 5)], 3, min_split=10, weight="w"), three).where("prediction = 2").count()
    assert heavy > plain
    imp = {r.feature: r.importance for r in FO.importance(FO.grow(data, [FO.Fit("a", 10)], min_split=10), names).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["f0"] == max(imp.values()) and imp["f4"] == 0
    one = data.limit(1)
    model = FO.grow(one, [FO.Fit("a", 3)])
    assert {r.feature for r in model.nodes.collect()} <= {-1}
    with pytest.raises(ValueError):
        FO.grow(data.withColumn("label", F.lit(None).cast("double")), [FO.Fit("a", 1)])


def test_stumps_are_those_of_whole_fits(spark):
    """The stump table gives, round by round, what a decision tree of depth 1 over weighted rows gives."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from loanlab.operators.adaboost import AdaBoost
    rng = np.random.default_rng(11)
    x = rng.integers(0, 30, (400, 4)) / 10.0
    y = ((x[:, 0] + x[:, 1] ** 2 / 3 + rng.normal(size=400) * 0.4) > 2.5).astype(float)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i])) for i in range(400)], "x array<double>, label double")
    df = df.select(array_to_vector("x").alias("features"), "label").repartition(3).persist()
    model = AdaBoost(maxIter=6).fit(df)
    w = np.full(400, 1 / 400)
    for stump, alpha in zip(model.stumps, model.alphas, strict=True):
        weighted = spark.createDataFrame([(x[i].tolist(), float(y[i]), float(w[i])) for i in range(400)],
                                         "x array<double>, label double, w double")
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", maxBins=64).fit(
            weighted.select(array_to_vector("x").alias("features"), "label", "w"))
        said = np.array([stump.predict(r) for r in x])
        whole = np.array([r.prediction for r in tree.transform(
            weighted.select(array_to_vector("x").alias("features"))).collect()])
        assert tree.toDebugString.count(f"feature {stump.feature} <= {stump.threshold}") == 1 and (said == whole).all()
        err = w[said != y].sum()
        assert alpha == pytest.approx(np.log((1 - err) / err), rel=1e-9)
        w = w * np.exp(alpha * (said != y))
        w /= w.sum()
    many = AdaBoost(maxIter=40).fit(df)
    out = many.transform(df).select("features", "label", "prediction").collect()
    assert len(many.stumps) == 40 and np.mean([r.label == r.prediction for r in out]) > 0.88
    flat = df.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    assert {r.prediction for r in AdaBoost(maxIter=3).fit(flat).transform(flat).collect()} == {float(y.mean() > 0.5)}


def test_packed_rows_are_the_rows():
    rng = np.random.default_rng(8)
    for sizes in ([2, 64, 1, 2, 7], [2] * 17, [64] * 3, [1]):
        pack = FO.Pack([list(range(s - 1)) for s in sizes])
        bins = np.column_stack([rng.integers(0, s, 50) for s in sizes]).astype(np.uint8)
        packed = pack.packed(bins)
        assert packed.shape == (50, sum(s > 2 for s in sizes) + -(-sum(s <= 2 for s in sizes) // 8))
        assert (pack.columns(packed) == bins.T).all()


@pytest.mark.parametrize("whole", [True, False])
def test_best_splits_against_loops(whole):
    """Cells one after the other, empty ones among them, against a loop over all splits."""
    rng = np.random.default_rng(2)
    sizes, k, m = np.array([2, 5, 64, 1, 2, 9]), 3, 3
    feats = np.array([rng.permutation(6)[:m] for _ in range(40)])
    first = FO._places(feats, sizes)
    sums = rng.integers(0, 3, (k + 1, first[-1])) * (rng.random(first[-1]) < 0.3) * (1.0 if whole else 0.1)
    for i in range(40):  # every node has a row
        sums[0, first[i * m]] += 1.0
    slot, cut, gain, left = FO.best_splits(sums, k, first, m, 64, FO.whole_numbers(sums))
    assert FO.whole_numbers(sums) == whole
    for i in range(40):
        gains = {}
        for j in range(m):
            own = sums[:, first[i * m + j]:first[i * m + j + 1]]
            for b in range(own.shape[1] - 1):
                a, c = own[:k, :b + 1].sum(axis=1), own[:k, b + 1:].sum(axis=1)
                if a.sum() > 0 and c.sum() > 0:
                    gains[(j, b)] = ((a ** 2).sum() / a.sum() + (c ** 2).sum() / c.sum(), own[:, :b + 1].sum(axis=1))
        if not gains:
            assert slot[i] == -1
            continue
        assert gain[i] == pytest.approx(max(g for g, _ in gains.values())) == pytest.approx(gains[(slot[i], cut[i])][0])
        assert left[:, i] == pytest.approx(gains[(slot[i], cut[i])][1])


def test_best_binary_against_the_general_splits():
    rng = np.random.default_rng(6)
    sizes, n, nodes, m = np.array([2, 5, 64, 1, 2, 9]), 120, 60, 3
    bins = np.array([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)
    size = np.bincount(np.append(rng.integers(0, nodes, n - nodes), np.arange(nodes)), minlength=nodes)
    y, w, rows = rng.integers(0, 2, n), rng.integers(1, 5, n).astype(float), rng.permutation(n)
    feats = np.array([rng.permutation(6)[:m] for _ in range(nodes)])
    first = FO._places(feats, sizes)
    want = FO.best_splits(FO._sums(bins.ravel(), n, rows, size, feats, first, [w[rows]], 2, y), 2, first, m, 64, True)
    counts = np.bincount(np.repeat(np.arange(nodes) * 2, size) + y[rows], w[rows], 2 * nodes).reshape(-1, 2)
    got = FO.best_binary(bins.ravel(), n, rows, size, feats, sizes, w[rows] * np.where(y[rows], FO.HALF, 1.0), counts)
    some = want[0] >= 0
    assert (got[0] == want[0]).all() and (got[1][some] == want[1][some]).all() and (got[2] == want[2]).all() and 0 < (~some).sum() < nodes
    assert (FO._orders(3, np.arange(9), 1, 20, 4) == FO._orders(3, np.arange(9), 1, 20)[:, :4]).all()


def test_trees_in_rounds_and_blocks_are_the_same(data, monkeypatch):
    """A tree at a time between gathering and growing and between leading and voting; nodes of few rows apart or together."""
    fits = [FO.Fit(str(i), 3, F.col("fold") != i) for i in range(3)]
    own = {str(i): F.col("fold") == i for i in range(3)}
    parts = [FO.Part(f"{i}", str(i), F.col("fold") == i) for i in range(3)]
    model = FO.grow(data, fits, local_rows=200)
    plain = _nodes(model), sorted(map(repr, FO.score(model, data, own).collect())), sorted(FO.part_accuracy(model, data, parts).collect())
    for name, value in (("ROUND_BYTES", 1), ("ROUND_ROW", 0), ("OWN_ROWS", 20), ("LEVEL_ROWS", 50), ("CELLS", 100), ("CELLS_A_PASS", 300), ("BLOCK_NODES", 2),
                        ("NODES_SENT", 0), ("SCORE_ROWS", 30), ("TASK_ROWS", 100)):
        monkeypatch.setattr(FO, name, value)
    again = FO.grow(data, fits, local_rows=200)
    assert (_nodes(again), sorted(map(repr, FO.score(again, data, own).collect())),
            sorted(FO.part_accuracy(again, data, parts).collect())) == plain
    every = {(r.tree, r.node): r for r in again.nodes.collect()}
    for (tree, node), r in every.items():
        if r.feature >= 0:
            below = [every[(tree, 2 * node + i)].counts for i in (1, 2)]
            assert r.below == pytest.approx(sum(sum(c * c for c in cs) / sum(cs) for cs in below))
